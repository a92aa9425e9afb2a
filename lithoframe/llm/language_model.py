"""A gated recurrent language model over words, in numpy.

Tokens are A-Z lower-cased words and one end per text.  The output softmax is
factored into classes: a word's class is predicted from the recurrent state,
then the member of its class.  The `HEAD` most frequent training words are the
members of classes of `CLASS_WORDS`.  Every other word counts as its last letter,
a member of the class of the mark after it, and is drawn among the words of that
ending from its smoothed corpus count, so every text has a probability and rare
words keep their weight.

Counts.  Documents are dealt into slices by a hash of their id.  A slice sends
each distinct word once, as a hash with its training count, to the hash's
shard; the shard adds up and answers with the corpus counts.  What is counted
therefore covers every training document and grows with the corpus, a frequent
word costs one entry per slice, and nothing but totals per class and the `HEAD`
words reaches the driver.

Weights.  Truncated backpropagation runs over every training document, in
`ROUNDS` rounds that share the documents out.  A round's trainers, of about
`TRAINER_BYTES` each, all start from the weights so far (at first the counts'
unigram distribution); their weights are averaged in groups of `FAN_IN`, level by
level.

Scoring steps through all documents of a slice side by side, window by window,
with the state carried from window to window to the end of every document.  A
very long text takes one step a word like any other; texts of like length share a
slice, so that few steps are for one text alone.

Edge cases: null and empty texts are one end token; repeated rows each give a
row, which share a slice where id and text are equal; a null id counts as training
and not as held out; ties in frequency go by the word's hash; without training
documents every count is zero and the scores are those of the untrained model;
an empty table gives an empty table; other input columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm.common import materialize, table, text_or_empty

HEAD, CLASS_WORDS = 2048, 64
#: Tail classes: kinds of mark after a word's last letter, times letters.
MARKS, LETTERS = 4, 28
TAIL = MARKS * LETTERS
HIDDEN = 16
SLICE_BYTES, SHARD_BYTES = 6_000_000, 96_000_000
#: Texts of up to 2 to the power of this bytes share slices.
LEAST_KIND = 13
TRAINER_BYTES, FAN_IN, ROUNDS, RATE = 6_000_000, 16, 2, 0.02
#: Updates of a trainer that has few tokens.
UPDATES = 96
#: The end token's hash; a word that hashed to it would count as an end.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Classes of the output: those of head words, and one for each kind of mark after a tail word's last letter.
CLASSES = HEAD // CLASS_WORDS + MARKS
#: Where each class's members begin, and the class of each member.
_BOUNDS = np.r_[np.arange(0, HEAD, CLASS_WORDS), HEAD + LETTERS * np.arange(MARKS + 1)]
_CLASS = np.repeat(np.arange(CLASSES), np.diff(_BOUNDS))


def tail_classes(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Class of each word by its last letter and the kind of mark after it."""
    a, b = offsets[:-1], offsets[1:]
    if not len(data):
        return np.zeros(len(a), np.uint8)
    at = lambda k: np.where(b - k >= a, data[np.maximum(b - k, 0) % len(data)], 0)
    last, before = at(1), at(2)
    letter = lambda x: np.where((x >= 97) & (x <= 122), x - 97, np.where(x >= 128, 26, 27))
    plain = (letter(last) < 27).astype(np.int64)
    mark = np.where(plain, 0, np.where(last == 46, 1, np.where(last == 44, 2, 3)))
    return (mark * LETTERS + np.where(plain, letter(last), letter(before))).astype(np.uint8)


class Words:
    """The tokens of a list of texts: distinct words, and a code for every token."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] is not None else np.empty(0, np.uint8)
        self.hash = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.empty(0, np.uint64)
        self.tail = tail_classes(offsets.astype(np.int64), data)
        keep = np.diff(offsets)[codes] > 0 if len(codes) else np.zeros(0, bool)
        kept = np.r_[0, np.cumsum(keep)]
        starts = kept[bounds]
        # an end after every text: its code is the number of words
        n = np.diff(starts)
        self.starts = np.r_[0, np.cumsum(n + 1)]
        self.codes = np.full(self.starts[-1], len(words), np.int64)
        inside = np.ones(len(self.codes), bool)
        inside[self.starts[1:] - 1] = False
        self.codes[inside] = codes[keep]
        self.hash = np.r_[self.hash, END].astype(np.uint64)
        self.tail = np.r_[self.tail, 0].astype(np.uint8)


class Vocabulary:
    """What the model knows of the corpus: totals, head words, and totals of the tail classes."""

    def __init__(self, tokens: int, kinds: int, head: list[tuple[int, int, int]], classes: dict[int, tuple[int, int]]):
        self.tokens, self.kinds = tokens, kinds
        head = head[:HEAD]
        self.order = np.array([h for h, _, _ in head], np.int64).view(np.uint64)
        self.counts = np.zeros(HEAD)
        self.counts[: len(head)] = [c for _, _, c in head]
        self.sort = np.argsort(self.order)
        self.sorted = self.order[self.sort]
        self.n, self.v = np.zeros(TAIL), np.zeros(TAIL)
        for k, (n, v) in classes.items():
            self.n[k], self.v[k] = n, v
        for h, k, c in head:
            if np.int64(h).view(np.uint64) != END:
                self.n[k] -= c
                self.v[k] -= 1

    def inputs(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Number of each word for the model: its head rank, or HEAD + its tail class."""
        out = HEAD + tails.astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            hit = self.sorted[at] == hashes
            out[hit] = self.sort[at[hit]]
        return out


def first_weights(vocab: Vocabulary) -> dict[str, np.ndarray]:
    """Weights whose output is the corpus's unigram distribution."""
    r, h = np.random.default_rng(3), HIDDEN
    weight = np.r_[vocab.counts + 0.1, np.maximum(vocab.n + vocab.v, 0) + 1]
    total = np.add.reduceat(weight, _BOUNDS[:-1])
    w = {
        "emb": r.normal(0, 0.3, (HEAD + TAIL, h)),
        "W": r.normal(0, h**-0.5, (h, 3 * h)),
        "U": r.normal(0, h**-0.5, (h, 3 * h)),
        "b": np.r_[np.ones(h), np.zeros(2 * h)],
        "C": r.normal(0, 0.02, (h, CLASSES)),
        "cb": np.log(total / total.sum()),
        "O": r.normal(0, 0.02, (HEAD + TAIL, h)),
        "ob": np.log(weight / np.repeat(total, np.diff(_BOUNDS))),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


def _gated(f: np.ndarray, gates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both gates, the candidate's share of the old state, and the candidate; (units, lanes) each."""
    d = HIDDEN
    zr, u = f[: 2 * d], f[2 * d :]
    zr += gates[: 2 * d]
    np.negative(zr, out=zr)
    np.exp(np.minimum(zr, 30, out=zr), out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    n = zr[d:] * u
    n += gates[2 * d :]
    return zr, u, np.tanh(n, out=n)


def step(gates: np.ndarray, h: np.ndarray, U: np.ndarray) -> np.ndarray:
    """The states after one token; all arrays (units, lanes), ``U`` transposed."""
    zr, _, n = _gated(U @ h, gates)
    h = h - n
    h *= zr[:HIDDEN]
    h += n
    return h


def _exp_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row and its sum; rows beyond the range of floats are lowered by their maximum, in ``x`` too."""
    with np.errstate(over="ignore"):
        e = np.exp(x)
        total = e @ np.ones(x.shape[1], x.dtype)
    if len(x) and not (total.min() > 1e-30 and total.max() < 1e30):
        x -= x.max(1, keepdims=True)
        e = np.exp(x)
        total = e.sum(1)
    return e, total


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the targets by class, the classes in that order, and where each class begins."""
    cls = _CLASS[target]
    order = np.argsort(cls, kind="stable")
    return order, cls[order], np.searchsorted(cls[order], np.arange(CLASSES + 1))


def _chunks(a: int, b: int, rows: int = 1024):
    """Ranges of few enough rows that their softmax stays in a core's cache."""
    return ((x, min(x + rows, b)) for x in range(a, b, rows))


def token_scores(w: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of P(class) P(member | class) of targets after states ``h`` (tokens, units)."""
    order, cls, cut = _by_class(target)
    x, t, out = h[order], target[order], np.empty(len(h), np.float32)
    for a, b in _chunks(0, len(x)):
        y = x[a:b] @ w["C"] + w["cb"]
        total = _exp_rows(y)[1]
        out[a:b] = y[np.arange(b - a), cls[a:b]] - np.log(total)
    for c in range(CLASSES):
        o = slice(_BOUNDS[c], _BOUNDS[c + 1])
        for a, b in _chunks(cut[c], cut[c + 1]):
            y = x[a:b] @ w["O"][o].T + w["ob"][o]
            total = _exp_rows(y)[1]
            out[a:b] += y[np.arange(b - a), t[a:b] - o.start] - np.log(total)
    back = np.empty_like(out)
    back[order] = out
    return back


def document_scores(w: dict[str, np.ndarray], tokens: np.ndarray, starts: np.ndarray, rows: int = 32768) -> np.ndarray:
    """Natural log-likelihood of every document's classes and their members."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    begin, size = starts[:-1][order], sizes[order]
    table_, U = np.ascontiguousarray((w["emb"] @ w["W"] + w["b"]).T), np.ascontiguousarray(w["U"].T)
    out, h, t = np.zeros(len(order)), np.zeros((HIDDEN, len(order)), np.float32), 0
    rising = -size
    while t < (size[0] if len(size) else 0):
        active = int(np.searchsorted(rising, -t, "left"))
        states, targets, owners = [], [], []
        for _ in range(max(1, rows // active)):
            active = int(np.searchsorted(rising, -t, "left"))
            if not active:
                break
            now = tokens[begin[:active] + t]
            h = np.ascontiguousarray(h[:, :active])
            states.append(h.T)
            targets.append(now)
            owners.append(np.arange(active))
            h = step(table_[:, now], h, U)
            t += 1
        got = token_scores(w, np.concatenate(states), np.concatenate(targets))
        out += np.bincount(np.concatenate(owners), got, len(out))
    final = np.empty(len(out))
    final[order] = out
    return final


def _output_gradients(w: dict[str, np.ndarray], flat: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the output layer, of the states (units + 1, tokens) before it, and the summed loss."""
    d, tiny = HIDDEN, flat.dtype.type(1e-30)
    order, cls, cut = _by_class(target)
    x, member = np.ascontiguousarray(flat.T)[order], target[order] - _BOUNDS[cls]
    C, back = np.vstack([w["C"], w["cb"]]), np.ascontiguousarray(w["C"].T)
    O, words = w["O"], np.hstack([w["O"], w["ob"][:, None]])
    gC, gO, dx, loss = np.zeros_like(C), np.zeros_like(words), np.empty((len(x), d), flat.dtype), 0.0
    for a, b in _chunks(0, len(x)):
        e, total = _exp_rows(x[a:b] @ C)
        e *= np.reciprocal(total)[:, None]
        at = np.arange(b - a), cls[a:b]
        loss -= float(np.log(e[at] + tiny).sum())
        e[at] -= 1
        gC += x[a:b].T @ e
        dx[a:b] = e @ back
    for c in range(CLASSES):
        o = slice(_BOUNDS[c], _BOUNDS[c + 1])
        for a, b in _chunks(cut[c], cut[c + 1]):
            e, total = _exp_rows(x[a:b] @ words[o].T)
            e *= np.reciprocal(total)[:, None]
            at = np.arange(b - a), member[a:b]
            loss -= float(np.log(e[at] + tiny).sum())
            e[at] -= 1
            gO[o] += e.T @ x[a:b]
            dx[a:b] += e @ O[o]
    states = np.empty_like(dx)
    states[order] = dx
    return {"C": gC[:d], "cb": gC[d], "O": gO[:, :d], "ob": gO[:, d]}, states, loss


def window_gradients(w: dict[str, np.ndarray], h: np.ndarray, last: np.ndarray, tokens: np.ndarray, fresh: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients over a window of (steps, lanes) tokens, its last state (lanes, units), and its loss per token.

    ``last`` are the tokens before the window; ``fresh`` marks tokens that begin a document.
    """
    d, (steps, lanes), kind = HIDDEN, tokens.shape, w["U"].dtype
    count, h = steps * lanes, np.ascontiguousarray(h.T)
    table_, U = np.ascontiguousarray((w["emb"] @ w["W"] + w["b"]).T), np.ascontiguousarray(w["U"].T)
    given = np.vstack([last[None], tokens[:-1]]).ravel()
    gates = np.take(table_, given, axis=1).reshape(3 * d, steps, lanes)
    old, n, u = (np.empty((d, steps, lanes), kind) for _ in range(3))
    zr, flat = np.empty((2 * d, steps, lanes), kind), np.ones((d + 1, steps, lanes), kind)
    keep, begins = (~fresh).astype(kind), fresh.any(1)
    for t in range(steps):
        old[:, t] = h
        zr[:, t], u[:, t], n[:, t] = _gated(U @ h, gates[:, t])
        h = h - n[:, t]
        h *= zr[:d, t]
        h += n[:, t]
        if begins[t]:
            h *= keep[t]
        flat[:d, t] = h
    g, states, loss = _output_gradients(w, flat.reshape(d + 1, count), tokens.ravel())
    dstates = np.ascontiguousarray(states.T).reshape(d, steps, lanes)
    # what the state's gradient is multiplied by, for all steps at once
    z, r = zr[:d], zr[d:]
    to_n = 1 - z
    to_z = (old - n) * z * to_n
    to_n *= 1 - n * n
    to_r = (1 - r) * r * u
    dh, U = np.zeros((d, lanes), kind), w["U"]
    du, dn = np.empty((3 * d, steps, lanes), kind), np.empty((d, steps, lanes), kind)
    for t in range(steps - 1, -1, -1):
        dh = dh + dstates[:, t]
        if begins[t]:
            dh *= keep[t]
        now, dn[:, t] = np.empty((3 * d, lanes), kind), dh * to_n[:, t]
        np.multiply(dh, to_z[:, t], out=now[:d])
        np.multiply(dn[:, t], to_r[:, t], out=now[d : 2 * d])
        np.multiply(dn[:, t], r[:, t], out=now[2 * d :])
        du[:, t] = now
        dh *= z[:, t]
        dh += U @ now
    du = du.reshape(3 * d, count)
    g["U"] = old.reshape(d, count) @ du.T
    du[2 * d :] = dn.reshape(d, count)
    order = np.argsort(given.astype(np.int16), kind="stable")
    ranked = given[order]
    cut = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    dtable = np.zeros((HEAD + TAIL, 3 * d), kind)
    dtable[ranked[cut]] = np.add.reduceat(np.take(du, order, axis=1), cut, axis=1).T
    g["W"], g["b"], g["emb"] = w["emb"].T @ dtable, dtable.sum(0), dtable @ w["W"].T
    return {k: (v / count).astype(kind) for k, v in g.items()}, h.T, loss / count


def fit(w: dict[str, np.ndarray], tokens: np.ndarray, starts: np.ndarray, rate: float, lanes: int = 512, steps: int = 8) -> dict[str, np.ndarray]:
    """Weights after one pass over the documents, by truncated backpropagation with Adam.

    Few tokens make fewer lanes, so that there are some `UPDATES` updates at least.
    """
    f32 = np.float32
    lanes = max(1, min(lanes, len(tokens) // (steps * UPDATES)))
    length, more = divmod(len(tokens), lanes)
    if not length:
        return w
    # the first lanes hold one token more than the rest, so that every token trains
    begin = np.arange(lanes) * length + np.minimum(np.arange(lanes), more)
    at = np.arange(length)[:, None] + begin
    first = np.zeros(len(tokens), bool)
    first[starts[:-1]] = True
    grid, fresh = tokens[at], first[at]
    fresh[0] = True
    windows = [(grid[t : t + steps], fresh[t : t + steps]) for t in range(0, length, steps)]
    if more:
        at = begin[:more][None] + length
        windows.append((tokens[at], first[at]))
    w = {k: v.copy() for k, v in w.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    h, last = np.zeros((lanes, HIDDEN), f32), np.zeros(lanes, np.int64)
    for k, (part, new) in enumerate(windows, 1):
        now = part.shape[1]
        g, h, _ = window_gradients(w, h[:now], last[:now], np.ascontiguousarray(part), new)
        last = part[-1]
        if now < lanes:
            # the last tokens count as many as they are
            share = f32(part.size / (lanes * steps))
            for d in g.values():
                d *= share
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = f32(min(1.0, 1.0 / (size + 1e-9)))
        for name, d in g.items():
            d *= clip
            m[name] += f32(0.1) * (d - m[name])
            v[name] += f32(0.01) * (d * d - v[name])
            w[name] -= f32(rate / (1 - 0.9**k)) * m[name] / (np.sqrt(v[name] * f32(1 / (1 - 0.99**k))) + f32(1e-5))
    return w


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def _texts(t: pa.Table) -> pa.Array:
    return t.column("__text").combine_chunks().cast(pa.string())


def _ordered(t: pa.Table) -> pa.Table:
    return t.sort_by([("__id", "ascending"), ("__text", "ascending")])


def _send_words(t: pa.Table, shards: int) -> pa.Table:
    """The distinct words of a slice with their training counts, by shard."""
    t = _ordered(t)
    words = Words(_texts(t))
    train = np.repeat(~t.column("__held").to_numpy(), np.diff(words.starts))
    count = np.bincount(words.codes[train], minlength=len(words.hash))
    hashes, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
    count = np.bincount(place, count, len(hashes)).astype("<u8")
    tail = words.tail[first]
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    some, cut = np.unique(shard[order], return_index=True)
    parts = np.split(order, cut[1:])
    number = t.column("__slice")[0].as_py()
    blob = lambda x: pa.array([x[p].tobytes() for p in parts], pa.binary())
    return pa.table({"shard": pa.array(some, pa.int32()), "slice": pa.array(np.full(len(some), number), pa.int32()), "hashes": blob(hashes.astype("<u8")), "tails": blob(tail), "counts": blob(count)})


def _add_up(t: pa.Table) -> pa.Table:
    """Corpus counts of a shard's words: back to the slices, the most frequent ones, and totals per class."""
    hashes = [np.frombuffer(x, "<u8") for x in t.column("hashes").to_pylist()]
    sizes = [len(x) for x in hashes]
    distinct, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    sent = np.frombuffer(b"".join(t.column("counts").to_pylist()), "<u8").astype(np.int64)
    order = np.argsort(place, kind="stable")
    count = np.add.reduceat(sent[order], np.searchsorted(place[order], np.arange(len(distinct))))
    tail = np.frombuffer(b"".join(t.column("tails").to_pylist()), np.uint8)[first]
    back = np.split(count.astype("<u8")[place], np.cumsum(sizes)[:-1])
    seen, word = count > 0, distinct != END
    n, v = np.zeros(TAIL, np.int64), np.bincount(tail[word & seen], minlength=TAIL)
    np.add.at(n, tail[word], count[word])
    top = np.argsort(-count, kind="stable")[:HEAD]
    top = top[count[top] > 0]
    k, shard = len(back), t.column("shard")[0].as_py()
    none = lambda m: [None] * m
    ends = int(count[~word].sum())
    columns = {
        "kind": (pa.int32(), [0] * k + [1] * TAIL + [2] * len(top) + [3]),
        "slice": (pa.int32(), t.column("slice").to_pylist() + none(TAIL + len(top) + 1)),
        "shard": (pa.int32(), [shard] * (k + TAIL + len(top) + 1)),
        "counts": (pa.binary(), [x.tobytes() for x in back] + none(TAIL + len(top) + 1)),
        "tail": (pa.int32(), none(k) + list(range(TAIL)) + tail[top].tolist() + [None]),
        "hash": (pa.int64(), none(k + TAIL) + distinct[top].view(np.int64).tolist() + [None]),
        "n": (pa.int64(), none(k) + n.tolist() + count[top].tolist() + [ends]),
        "v": (pa.int64(), none(k) + v.tolist() + none(len(top)) + [int(ends > 0)]),
    }
    return pa.table({c: pa.array(x, kind) for c, (kind, x) in columns.items()})


def _train(t: pa.Table, w: dict[str, np.ndarray], vocab: Vocabulary, rate: float) -> pa.Table:
    t = _ordered(t)
    words = Words(_texts(t))
    tokens = vocab.inputs(words.hash, words.tail)[words.codes]
    return pa.table({"part": pa.array([t.column("__slice")[0].as_py() // FAN_IN], pa.int32()), "tokens": pa.array([len(tokens)], pa.int64()), "weights": pa.array([pickle.dumps(fit(w, tokens, words.starts, rate))], pa.binary())})


def _trainer(w: dict[str, np.ndarray], vocab: Vocabulary, rate: float):
    return lambda t: _train(t, w, vocab, rate)


def _average(t: pa.Table) -> pa.Table:
    share = np.array(t.column("tokens").to_pylist(), np.float64)
    total = None
    for x, s in zip(t.column("weights").to_pylist(), share / share.sum()):
        one = pickle.loads(x)
        total = {k: v * s for k, v in one.items()} if total is None else {k: total[k] + one[k] * s for k in total}
    return pa.table({"part": pa.array([t.column("part")[0].as_py() // FAN_IN], pa.int32()), "tokens": pa.array([int(share.sum())], pa.int64()), "weights": pa.array([pickle.dumps({k: v.astype(np.float32) for k, v in total.items()})], pa.binary())})


def _score(t: pa.Table, counts: pa.Table, w: dict[str, np.ndarray], vocab: Vocabulary, shards: int) -> pa.Table:
    if not t.num_rows:
        return pa.table({"__id": t.column("__id"), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
    t = _ordered(t)
    words = Words(_texts(t))
    hashes, place = np.unique(words.hash, return_inverse=True)
    order = np.argsort((hashes % np.uint64(shards)).astype(np.int64), kind="stable")
    count = np.empty(len(hashes), np.int64)
    blobs = sorted(zip(counts.column("shard").to_pylist(), counts.column("counts").to_pylist()))
    count[order] = np.frombuffer(b"".join(x for _, x in blobs), "<u8")
    count = count[place]
    inputs, tail = vocab.inputs(words.hash, words.tail), words.tail.astype(np.int64)
    within = np.where(inputs < HEAD, 0.0, np.log((count + 1) / (np.maximum(vocab.n + vocab.v, 0)[tail] + 1)))
    base = np.log10((count + 1) / (vocab.tokens + vocab.kinds + 1))
    sums = lambda x: np.add.reduceat(x[words.codes], words.starts[:-1])
    score = (document_scores(w, inputs[words.codes], words.starts) + sums(within)) / np.log(10)
    return pa.table({"__id": t.column("__id"), "held_out": t.column("__held"), "n_tokens": pa.array(np.diff(words.starts), pa.int64()), "n_known": pa.array(sums((count > 0).astype(np.int64)), pa.int64()), "base_score": pa.array(sums(base), pa.float64()), "score": pa.array(score, pa.float64())})


def _dealt(df: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, int]:
    """Every row with its ``__slice``, and the bytes of all texts.

    A slice has texts of like length, since they are scored side by side, and
    about `SLICE_BYTES`; its rows are dealt by id and text, so that rows without
    an id spread as well.
    """
    kind = F.greatest(F.lit(LEAST_KIND), F.floor(F.log2(F.octet_length(text) + 1)).cast("int"))
    sizes = {r.kind: r.n for r in df.groupBy(kind.alias("kind")).agg(F.sum(F.octet_length(text)).alias("n")).collect()}
    first, number = 0, F.lit(0)
    for k, n in sorted(sizes.items()):
        slices = max(1, -(-n // SLICE_BYTES))
        number = F.when(F.col("__kind") == k, F.pmod(F.xxhash64("__id", "__text"), F.lit(slices)) + first).otherwise(number)
        first += slices
    rows = df.select(F.col(id_col).alias("__id"), held_out(id_col).alias("__held"), text.alias("__text"), kind.alias("__kind"))
    return rows.select(number.cast("int").alias("__slice"), "__id", "__held", "__text"), sum(sizes.values())


def _by_hash(salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "__id", "__text"), F.lit(n)).cast("int")


def learned(docs: DataFrame, total: int, vocab: Vocabulary) -> dict[str, np.ndarray]:
    """Weights after all training documents of ``docs``, each in one of `ROUNDS` rounds."""
    weights, kinds = first_weights(vocab), "part int, tokens long, weights binary"
    trainers = max(1, -(-total // (ROUNDS * TRAINER_BYTES)))
    dealt = docs.where(~F.col("__held")).withColumn("__round", _by_hash("round", ROUNDS)).withColumn("__slice", _by_hash("trainer", trainers))
    for k in range(ROUNDS):
        parts = dealt.where(F.col("__round") == k).drop("__round").groupBy("__slice").applyInArrow(_trainer(weights, vocab, RATE / (1 + 2 * k)), kinds)
        left = trainers
        while left > 1:
            parts = materialize(parts, "weights").groupBy("part").applyInArrow(_average, kinds)
            left = -(-left // FAN_IN)
        got = parts.collect()
        if got:
            weights = pickle.loads(got[0].weights)
    return weights


def score_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    docs, total = _dealt(df, id_col, text_or_empty(text_col))
    shards = max(12, -(-total // SHARD_BYTES))
    words = docs.groupBy("__slice").applyInArrow(lambda t: _send_words(t, shards), "shard int, slice int, hashes binary, tails binary, counts binary")
    counted = materialize(words.groupBy("shard").applyInArrow(_add_up, "kind int, slice int, shard int, counts binary, tail int, hash long, n long, v long"), "counts")
    classes = {r.tail: (r.n, r.v) for r in counted.where("kind = 1").groupBy("tail").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    head = [(r.hash, r.tail, r.n) for r in counted.where("kind = 2").orderBy(F.desc("n"), "hash").limit(HEAD).collect()]
    ends = counted.where("kind = 3").agg(F.sum("n").alias("n"), F.max("v").alias("v")).first()
    vocab = Vocabulary(sum(n for n, _ in classes.values()) + (ends.n or 0), sum(v for _, v in classes.values()) + (ends.v or 0), head, classes)
    weights = learned(docs, total, vocab)
    back = counted.where("kind = 0").select("slice", "shard", "counts")
    done = docs.groupBy("__slice").cogroup(back.groupBy("slice")).applyInArrow(lambda t, c: _score(t, c, weights, vocab, shards), f"__id {df.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("__id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
