"""Removal of repeated byte strings by distributed prefix-free parsing.

A byte goes if it lies in a string of ``length`` bytes that also starts in a
document with a smaller id.

Parsing.  A rolling hash is taken of every ``gram`` bytes; the smallest one in
each window of ``length`` bytes is the window's trigger.  Neighbouring windows
share triggers, so the triggers cut a text into phrases: phrase i spans all
windows whose trigger is i, and neighbouring phrases overlap by ``length`` - 1
bytes.  Which trigger a window has depends on its own bytes only, so equal
windows lie in phrases with equal triggers, and each window lies in exactly one
phrase.  The distinct phrases are the dictionary, their places in the documents
the parse.

Order.  The suffixes of the dictionary are sorted by their first ``length``
bytes; as every window ends inside its phrase, this suffix array and the parse's
least document of each phrase already give the corpus order down to that depth.
(The parse's own suffix array would only order what lies beyond it.)

Distribution.  Documents are dealt by a hash of id and text into slices of about
`SLICE_BYTES`; one exchange of the texts serves all three passes over them.
A pass sends only what other slices must know:

1. the distinct triggers of a slice (four bytes each), to find those that occur
   in two documents at all; the others' windows are unique and go no further;
2. the distinct phrases of the remaining triggers with their least document, to
   the trigger's shard, where dictionary suffixes are sorted and compared;
3. a bit mask of repeated windows per distinct phrase, back to the slice.

A trigger, passage or group of copies that a third of all documents share is
sent once per slice and not once per document.  A phrase of a trigger found in
more than ``hot_slices`` slices is cut in two at its middle window: all windows of
the one part hold the same bytes to the left of the trigger and those of the other
the same bytes to its right, and these decide the part's shard.  Triggers of more
than `HOT_PHRASES` phrases send their windows one by one, sharded by their own
bytes, so no shard gathers all contexts of a frequent string.  Hash collisions only
let a unique phrase through to the exact comparison.

Edge cases: null text is empty; a text shorter than ``length`` keeps all bytes; a
very long text is read whole, in tiles of a megabyte, by the task of its slice;
rows with equal ids do not remove each other's bytes (so ties and repeated rows stay); a null id counts as larger
than every id, so such rows lose bytes but take none; an empty table gives an
empty table; other input columns pass only if asked for.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm.common import table, text_or_empty

SLICE_BYTES = 4_000_000
#: Text bytes whose triggers go to one shard.
SHARD_BYTES = 4_000_000
HOT_SLICES = 1024
#: Phrases of one trigger, summed over the slices, that one shard takes.
HOT_PHRASES = 65_536
_TILE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_NO_ID = np.iinfo(np.int64).max


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _BASE, pow(_BASE, -1, 1 << 64)
    return np.cumprod(up), np.cumprod(down)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed rolling hash of every ``gram`` bytes of at most a tile."""
    up, down = _powers(_TILE + 256)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


class Slice:
    """The documents of a slice, in order of id, and their phrases.

    Phrase k holds the windows that start at ``first[k]`` to ``first[k] +
    count[k] - 1`` of ``data``, in document ``doc[k]``; its trigger stands at
    ``at[k]`` and hashes to ``key[k]``.  Equal phrases have equal ``look[k]``, and
    almost always only those.
    """

    def __init__(self, ids: list, texts: list[str], length: int, gram: int):
        raw = [t.encode() for t in texts]
        key = [_NO_ID if i is None else i for i in ids]
        self.order = sorted(range(len(raw)), key=lambda k: (key[k], raw[k]))
        self.ids = np.array([key[k] for k in self.order], np.int64)
        self.raw_ids = [ids[k] for k in self.order]
        self.sizes = np.array([len(raw[k]) for k in self.order], np.int64)
        self.data = np.frombuffer(b"".join(raw[k] for k in self.order), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.length, self.gram = length, gram
        first, count, keys, places, looks = [], [], [], [], []
        span, mask = length - gram + 1, np.uint64(_TILE - 1)
        step = _TILE - length
        for at in range(0, max(len(self.data) - length + 1, 0), step):
            tile = self.data[at : at + step + length - 1]
            h = gram_hashes(tile, gram)
            packed = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
            trigger = (_sliding_min(packed, span) & mask).astype(np.int64)
            whole = np.ones(len(trigger), bool)
            for e in self.ends[np.searchsorted(self.ends, at, "right") : np.searchsorted(self.ends, at + len(tile), "left")] - at:
                whole[max(0, e - length + 1) : e] = False
            starts = np.flatnonzero(whole)
            if not len(starts):
                continue
            own = trigger[starts]
            cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)])
            first.append(starts[cut] + at)
            count.append(np.diff(np.r_[cut, len(starts)]))
            keys.append(h[own[cut]])
            places.append(own[cut] + at)
            a, z = starts[cut], starts[cut] + count[-1] + span - 2
            look = h[a]
            for near in (np.maximum(own[cut] - gram, a), np.minimum(own[cut] + gram, z), z):
                look = (look ^ (look >> np.uint64(31))) * np.uint64(_BASE) + h[near]
            looks.append(look)
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.first, self.count, self.key = join(first, np.int64), join(count, np.int64), join(keys, np.uint64)
        self.at, self.look = join(places, np.int64), join(looks, np.uint64)
        self.doc = np.searchsorted(self.ends, self.first, "right")

    def triggers(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (shard << 32 | rest of the key), ascending, and each phrase's place in it."""
        both = ((self.key >> np.uint64(32)) % np.uint64(shards) << np.uint64(32)) | (self.key & np.uint64(0xFFFFFFFF))
        return np.unique(both, return_inverse=True)

    def entries(self, state: np.ndarray, place: np.ndarray, shards: int):
        """Distinct surviving phrases in order of appearance, and where they lie.

        Returns the dictionary (bytes -> number), each entry's shard and least
        id, and, for every surviving phrase, part or window: its entry, start,
        windows and id.
        """
        data, half = self.data.tobytes(), (self.length - self.gram) // 2
        alive = np.flatnonzero(state[place] & 1) if len(place) else place
        hot = state[place[alive]] if len(alive) else alive
        whole, two, each = alive[hot & 6 == 0], alive[hot & 6 == 2], alive[hot & 4 > 0]
        mid = np.clip(self.at[two] - half, self.first[two], self.first[two] + self.count[two])
        one = np.repeat(each, self.count[each])
        shift = np.arange(len(one)) - np.repeat(np.cumsum(self.count[each]) - self.count[each], self.count[each])
        single = self.first[one] + shift
        phrase = np.concatenate([whole, two, two, one])
        start = np.concatenate([self.first[whole], self.first[two], mid, single])
        windows = np.concatenate([self.count[whole], mid - self.first[two], self.first[two] + self.count[two] - mid, np.ones(len(one), np.int64)])
        # the bytes that all windows of a part have: those decide its shard
        own = np.concatenate([self.first[whole], self.at[two] - half - 1, self.at[two], single])
        size = np.repeat([0, half + 1 + self.gram, self.length - half, self.length], [len(whole), len(two), len(two), len(one)])
        order = np.flatnonzero(windows)
        order = order[np.argsort(start[order], kind="stable")]
        phrase, start, windows, own, size = (x[order] for x in (phrase, start, windows, own, size))
        texts = [data[a:b] for a, b in zip(start.tolist(), (start + windows + (self.length - 1)).tolist())]
        known = {x: k for k, x in enumerate(dict.fromkeys(texts))}
        entry = np.fromiter(map(known.__getitem__, texts), np.int64, len(texts))
        ids = self.ids[self.doc[phrase]] if len(phrase) else phrase
        lead = np.unique(entry, return_index=True)[1]
        shard = (((self.key[phrase[lead]] * np.uint64(_BASE)) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
        for k in np.flatnonzero(size[lead]).tolist():
            a = int(own[lead[k]])
            shard[k] = int.from_bytes(hashlib.blake2b(data[a : a + int(size[lead[k]])], digest_size=6).digest()) % shards
        return known, shard, ids[lead], entry, start, windows, ids


def _column(t: pa.Table, name: str) -> list:
    return t.column(name).to_pylist()


def _slice_of(t: pa.Table, length: int, gram: int) -> Slice:
    return Slice(_column(t, "__id"), _column(t, "__text"), length, gram)


def _send_triggers(t: pa.Table, length: int, gram: int, shards: int) -> pa.Table:
    """Pass 1: the distinct triggers of a slice, with a flag for those of two documents and, from bit 1 on, the power of two that their distinct phrases reach."""
    s = _slice_of(t, length, gram)
    keys, place = s.triggers(shards)
    low, high = np.full(len(keys), _NO_ID), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, place, s.doc)
    np.maximum.at(high, place, s.doc)
    phrases = np.bincount(place[np.unique(s.look, return_index=True)[1]], minlength=len(keys))
    shard, flags = (keys >> np.uint64(32)).astype(np.int64), ((low < high) + 2 * np.ceil(np.log2(np.maximum(phrases, 1)))).astype(np.uint8)
    some, first = np.unique(shard, return_index=True)
    blobs = lambda x: pa.array([part.tobytes() for part in np.split(x, first[1:])][: len(some)], pa.binary())
    number = np.full(len(some), _column(t, "__slice")[0])
    return pa.table({"shard": pa.array(some, pa.int32()), "slice": pa.array(number, pa.int32()), "keys": blobs(keys.astype("<u4")), "flags": blobs(flags)})


def _judge_triggers(t: pa.Table, hot_slices: int) -> pa.Table:
    """A shard's triggers: bit 0 if two documents have it, bit 1 if very many slices do, bit 2 if it has very many phrases."""
    keys = [np.frombuffer(x, "<u4") for x in _column(t, "keys")]
    flags = np.concatenate([np.frombuffer(x, np.uint8) for x in _column(t, "flags")])
    distinct, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    several = np.zeros(len(distinct), bool)
    several[place[flags & 1 > 0]] = True
    phrases = np.bincount(place, weights=np.exp2((flags >> 1).astype(np.float64)))
    state = ((several | (times > 1)) + 2 * (times > hot_slices) + 4 * (phrases > HOT_PHRASES)).astype(np.uint8)[place]
    parts = np.split(state, np.cumsum([len(x) for x in keys])[:-1])
    return pa.table({"slice": t.column("slice"), "shard": t.column("shard"), "kind": pa.array([0] * len(parts), pa.int32()), "blob": pa.array([x.tobytes() for x in parts], pa.binary())})


def _blobs(t: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    return sorted((p, b) for p, k, b in zip(_column(t, "shard"), _column(t, "kind"), _column(t, "blob")) if k == kind)


def _state(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(b for _, b in _blobs(t, 0)), np.uint8)


def _send_phrases(t: pa.Table, known: pa.Table, length: int, gram: int, shards: int) -> pa.Table:
    """Pass 2: the distinct phrases of a slice whose triggers two documents have."""
    out: dict[str, list] = {"shard": [], "slice": [], "least": [], "sizes": [], "data": []}
    if t.num_rows:
        s = _slice_of(t, length, gram)
        phrases, shard, least, *_ = s.entries(_state(known), s.triggers(shards)[1], shards)
        texts = list(phrases)
        sizes = np.array([len(x) for x in texts], np.int64)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            out["shard"].append(int(shard[part[0]]))
            out["slice"].append(_column(t, "__slice")[0])
            out["least"].append(least[part].astype("<i8").tobytes())
            out["sizes"].append(sizes[part].astype("<u2").tobytes())
            out["data"].append(b"".join(texts[k] for k in part.tolist()))
    kinds = {"shard": pa.int32(), "slice": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})


def dictionary_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``starts`` by their first ``length`` bytes, and where a new string begins in it."""
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    strings = np.ascontiguousarray(view[starts]).view(f"S{length}").ravel()
    order = np.argsort(strings, kind="stable")
    ranked = strings[order]
    return order, np.r_[True, ranked[1:] != ranked[:-1]]


def _mark_windows(t: pa.Table, length: int) -> pa.Table:
    """A shard's phrases: for each slice's phrase, the windows that a smaller document has."""
    sizes = [np.frombuffer(x, "<u2").astype(np.int64) for x in _column(t, "sizes")]
    least = np.concatenate([np.frombuffer(x, "<i8") for x in _column(t, "least")])
    size = np.concatenate(sizes)
    text = b"".join(_column(t, "data"))
    ends = np.cumsum(size).tolist()
    texts = [text[a:b] for a, b in zip([0, *ends], ends)]
    dictionary = {x: k for k, x in enumerate(dict.fromkeys(texts))}
    place = np.fromiter(map(dictionary.__getitem__, texts), np.int64, len(texts))
    lowest = np.full(len(dictionary), _NO_ID)
    np.minimum.at(lowest, place, least)
    phrases = np.array([len(x) for x in dictionary], np.int64)
    data = np.frombuffer(b"".join(dictionary), np.uint8)
    windows = phrases - length + 1
    owner = np.repeat(np.arange(len(phrases)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = np.repeat(np.cumsum(phrases) - phrases, windows) + within
    order, new = dictionary_order(data, starts, length)
    low = np.minimum.reduceat(lowest[owner[order]], np.flatnonzero(new)) if len(order) else lowest
    best = np.empty(len(owner), np.int64)
    best[order] = low[np.cumsum(new) - 1]
    # the windows of every slice's phrase, by those of its dictionary phrase
    many = windows[place]
    of = np.repeat(np.arange(len(place)), many)
    j = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    hit = best[(np.cumsum(windows) - windows)[place[of]] + j] < least[of]
    masks = np.zeros(len(place), np.uint64)
    np.bitwise_or.at(masks, of[hit], np.uint64(1) << j[hit].astype(np.uint64))
    parts = np.split(masks, np.cumsum([len(x) for x in sizes])[:-1])
    return pa.table({"slice": t.column("slice"), "shard": t.column("shard"), "kind": pa.array([1] * len(parts), pa.int32()), "blob": pa.array([x.astype("<u8").tobytes() for x in parts], pa.binary())})


def _remove_bytes(t: pa.Table, known: pa.Table, length: int, gram: int, shards: int, with_kept: bool) -> pa.Table:
    """Pass 3: what is left of each document of a slice."""
    out: dict[str, list] = {"__id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    if t.num_rows:
        s = _slice_of(t, length, gram)
        _, shard, least, entry, start, windows, ids = s.entries(_state(known), s.triggers(shards)[1], shards)
        masks = np.zeros(len(least), np.uint64)
        masks[np.argsort(shard, kind="stable")] = np.frombuffer(b"".join(b for _, b in _blobs(known, 1)), "<u8")
        full = ~np.uint64(0)
        mine = np.where(ids > least[entry], full, masks[entry]) if len(entry) else masks
        covered = np.zeros(len(s.data) + 1, np.int32)
        for j in range(int(windows.max()) if len(windows) else 0):
            hit = (windows > j) & ((mine >> np.uint64(j)) & np.uint64(1) > 0)
            covered[start[hit] + j] = 1
        sums = np.cumsum(covered)[:-1]
        gone = sums > 0
        gone[length:] = sums[length:] > sums[:-length]
        for k, (i, n, e) in enumerate(zip(s.raw_ids, s.sizes.tolist(), s.ends.tolist())):
            g = gone[e - n : e]
            removed = int(np.count_nonzero(g))
            kept = s.data[e - n : e][~g].tobytes() if removed else s.data[e - n : e].tobytes()
            out["__id"].append(i)
            out["n_bytes"].append(n)
            out["n_removed"].append(removed)
            out["n_spans"].append(int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if removed else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode(errors="ignore") if with_kept else None)
    kinds = {"kept_sha256": pa.string(), "kept": pa.string()}
    if not with_kept:
        del out["kept"]
    done = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}
    if t.num_rows:
        rows = pa.array(s.order, pa.int64())
        done |= {c: t.column(c).take(rows) for c in t.column_names if c not in ("__id", "__text", "__slice")}
    else:
        done |= {c: t.column(c) for c in t.column_names if c not in ("__id", "__text", "__slice")}
    return pa.table(done)


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 16, with_kept: bool = False, carry: tuple[str, ...] = (), hot_slices: int = HOT_SLICES) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row; ``kept`` and ``__carried`` (a struct of ``carry``) if asked for.

    ``kept`` is the text of the remaining bytes, without characters that lost some of their bytes.
    """
    if not gram < length < gram + 64:
        raise ValueError("gram < length < gram + 64")
    text = text_or_empty(text_col)
    total = df.select(F.sum(F.octet_length(text))).first()[0] or 0
    slices, shards = max(1, -(-total // SLICE_BYTES)), max(12, -(-total // SHARD_BYTES))
    held = [f"__c{k}" for k in range(len(carry))]
    docs = df.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(slices)).cast("int").alias("__slice"), F.col(id_col).cast("long").alias("__id"), text.alias("__text"), *[F.col(c).alias(h) for c, h in zip(carry, held)])
    answer = "slice int, shard int, kind int, blob binary"
    triggers = docs.groupBy("__slice").applyInArrow(lambda t: _send_triggers(t, length, gram, shards), "shard int, slice int, keys binary, flags binary")
    judged = triggers.groupBy("shard").applyInArrow(lambda t: _judge_triggers(t, hot_slices), answer)
    phrases = docs.groupBy("__slice").cogroup(judged.groupBy("slice")).applyInArrow(lambda t, k: _send_phrases(t, k, length, gram, shards), "shard int, slice int, least binary, sizes binary, data binary")
    marked = phrases.groupBy("shard").applyInArrow(lambda t: _mark_windows(t, length), answer)
    schema = "__id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_kept + "".join(f", {h} {docs.schema[h].dataType.simpleString()}" for h in held)
    done = docs.groupBy("__slice").cogroup(judged.unionByName(marked).groupBy("slice")).applyInArrow(lambda t, k: _remove_bytes(t, k, length, gram, shards, with_kept), schema)
    return done.select(F.col("__id").cast(df.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept, *([F.struct(*[F.col(h).alias(c) for c, h in zip(carry, held)]).alias("__carried")] if carry else []))


def op10_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
