"""SimHash groups, suffix-array dedup and fingerprints against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from lithoframe.llm import fingerprints as G
from lithoframe.llm import near_dedup as N
from lithoframe.llm import suffix_dedup as S
from lithoframe.llm.common import materialize
from lithoframe.operators.components import connected_components
from tests.llm.corpus import documents, edge_frames, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, radius):
    """Class of every value by links of at most ``radius`` bits."""
    of = list(range(len(values)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    a = np.array(values, np.uint64)
    for k in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[k]) <= radius):
            p, q = find(k), find(int(j))
            of[max(p, q)] = min(p, q)
    return [find(k) for k in range(len(a))]


def test_near_duplicates_equal_brute_force(spark):
    rows = documents()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in N.near_duplicates(frame(spark, rows)).collect()}
    prints = [fingerprint(t) for _, t in rows]
    of = groups(prints, 4)
    assert got == {i: (f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, of)}
    kept = {r.doc_id for r in N.keep_one_of_each(frame(spark, rows)).collect()}
    assert kept == {rows[c][0] for c in of}


def test_segments_stay_cheap():
    for power in range(1, 9):
        plan = N.segments(10**power, 4)
        assert sum(near + 1 for _, _, near in plan) == 5 and sum(width for _, width, _ in plan) <= 64
        assert N.listings(plan) < 40
    # beyond some 5 * 10**8, looking up more values is cheaper than comparing crowded ones
    assert N.listings(N.segments(10**10, 4)) < 300


def test_every_segment_plan_gives_the_same_components(spark, monkeypatch):
    r = random.Random(1)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    values = set()
    for _ in range(120):
        x = r.getrandbits(64)
        values |= {x, *(flip(x, r.randrange(1, 8)) for _ in range(r.randrange(5)))}
    centre = r.getrandbits(64)
    values |= {flip(centre, r.randrange(1, 6)) for _ in range(150)}
    values = sorted(values)
    of = groups(values, 4)
    want = {frozenset(np.array([v for v, c in zip(values, of) if c == k], np.uint64).view(np.int64).tolist()) for k in set(of)}
    want = {w for w in want if len(w) > 1}
    distinct = materialize(spark.createDataFrame([(x,) for x in np.array(values, np.uint64).view(np.int64).tolist()], "fp long"), "fp")
    for n, light, block in ((1000, 48, 4096), (2**20, 4, 37), (2**31, 48, 4096)):
        monkeypatch.setattr(N, "LIGHT", light)
        monkeypatch.setattr(N, "BLOCK", block)
        plan = N.segments(n, 4)
        assert sum(t + 1 for _, _, t in plan) == 5
        found = {}
        for x in connected_components(N.links(distinct, 4, plan)).collect():
            found.setdefault(x.component, set()).add(x.node)
        assert {frozenset(v) for v in found.values()} == want


def removed(rows, length=50):
    """What the contract says, position by position."""
    out, seen = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], set()).add(i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if min(seen[b[s : s + length]]) < i:
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    rows = documents(90)
    for slice_bytes, hot in ((3_000_000, 1024), (4_000, 1024), (4_000, 2)):
        monkeypatch.setattr(S, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(S, "SHARD_BYTES", slice_bytes)
        got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(frame(spark, rows), hot_slices=hot).collect()}
        assert got == removed(rows)


def test_triggers_of_many_slices_are_hot():
    blob = lambda kind, *x: np.array(x, kind).tobytes()
    t = pa.table({"slice": pa.array([0, 1, 2], pa.int32()), "shard": pa.array([0] * 3, pa.int32()), "keys": [blob("<u4", 5, 6), blob("<u4", 5), blob("<u4", 5, 7)], "flags": [blob("u1", 0, 1), blob("u1", 0), blob("u1", 0, 0)]})
    state = lambda hot: [list(x) for x in S._judge_triggers(t, hot).column("blob").to_pylist()]
    assert state(2) == [[3, 1], [3], [3, 0]]
    assert state(3) == [[1, 1], [1], [1, 0]]


def test_hot_triggers_send_few_bytes_and_stay_exact(spark, monkeypatch):
    """Phrases of triggers of many slices go in two parts; only very many phrases of one trigger go window by window."""
    rows = documents(90)
    s = S.Slice(list(range(len(rows))), [t or "" for _, t in rows], 50, 16)
    keys, place = s.triggers(1)
    sent = {k: s.entries(np.full(len(keys), k, np.uint8), place, 1) for k in (1, 3, 5)}
    size = {k: sum(map(len, e[0])) for k, e in sent.items()}
    assert size[3] < 2 * size[1] < size[5] / 2
    window = lambda e: sorted(a + j for a, n in zip(e[4].tolist(), e[5].tolist()) for j in range(n))
    assert window(sent[1]) == window(sent[3]) == window(sent[5])
    for state in (3, 5):
        known, shard, _, entry, start, windows, _ = s.entries(np.full(len(keys), state, np.uint8), place, 1000)
        of = {}
        for e, a, n in zip(entry.tolist(), start.tolist(), windows.tolist()):
            for j in range(n):
                w = s.data[a + j : a + j + 50].tobytes()
                assert of.setdefault(w, shard[e]) == shard[e]
    monkeypatch.setattr(S, "SLICE_BYTES", 4_000)
    monkeypatch.setattr(S, "SHARD_BYTES", 4_000)
    for hot, phrases in ((2, 8), (1024, 4)):
        monkeypatch.setattr(S, "HOT_PHRASES", phrases)
        assert {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(frame(spark, rows), hot_slices=hot).collect()} == removed(rows)


def test_triggers_of_many_phrases_go_by_windows():
    blob = lambda kind, *x: np.array(x, kind).tobytes()
    t = pa.table({"slice": pa.array([0, 1], pa.int32()), "shard": pa.array([0] * 2, pa.int32()), "keys": [blob("<u4", 5, 6), blob("<u4", 5)], "flags": [blob("u1", 2 * 15, 1), blob("u1", 2 * 15 + 1)]})
    assert [list(x) for x in S._judge_triggers(t, 8).column("blob").to_pylist()] == [[1, 1], [1]]
    t = t.set_column(3, "flags", [[blob("u1", 2 * 16, 1), blob("u1", 2 * 15 + 1)]])
    assert [list(x) for x in S._judge_triggers(t, 8).column("blob").to_pylist()] == [[5, 1], [5]]


def test_rows_without_an_id_spread(spark, monkeypatch):
    """Their texts go to many slices, lose bytes to every id and take none from each other."""
    monkeypatch.setattr(S, "SLICE_BYTES", 1000)
    passage = "".join(chr(97 + k * 7 % 26) for k in range(60))
    rows = [(None, f"{k:04d} " + passage) for k in range(200)] + [(5, passage)]
    got = S.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.n_removed, r.n_spans) for r in got) == [(False, 0, 0)] + [(True, 60, 1)] * 200


def test_phrases_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(S, "_TILE", 1 << 12)
    S._powers.cache_clear()
    r = random.Random(9)
    texts = ["".join(r.choice("ab ") for _ in range(n)) for n in (0, 49, 50, 51, 9000, 300)]
    s = S.Slice(list(range(6)), texts, 50, 16)
    S._powers.cache_clear()
    starts = sorted(a + j for a, n in zip(s.first, s.count) for j in range(n))
    want, at = [], 0
    for t in texts:
        want += range(at, at + max(0, len(t) - 49))
        at += len(t)
    assert starts == want
    # equal windows have equal triggers
    of = {}
    for a, n, k in zip(s.first.tolist(), s.count.tolist(), s.key.tolist()):
        for j in range(n):
            w = s.data[a + j : a + j + 50].tobytes()
            assert of.setdefault(w, k) == k


def test_kept_text_and_carried_columns(spark):
    rows = documents(40)
    df = frame(spark, rows, clash=True)
    got = S.remove_repeats(df, with_kept=True, carry=("score", "kept")).collect()
    want = removed(rows)
    for r in got:
        assert r["__carried"].score == "clash" and r["__carried"].kept == "clash"
        if not want[r.doc_id][1]:
            assert r.kept == (dict(rows)[r.doc_id] or "")


def test_fingerprints(spark, monkeypatch):
    rows = documents()
    for run_rows in (4000, 3):
        monkeypatch.setattr(G, "RUN_ROWS", run_rows)
        monkeypatch.setattr(G, "QUANTILES", 4 if run_rows == 3 else 512)
        got = {r.doc_id: r for r in G.edited_fingerprints(frame(spark, rows)).collect()}
        assert len(got) == len(rows)
        of = {}
        for k, (i, t) in enumerate(rows):
            t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
            h = len(t) // 2
            edited = t[: len(t) - h] + after[:h]
            assert got[i].n_chars == len(t)
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert of.setdefault(t, got[i].fingerprint) == got[i].fingerprint
            if edited in of:
                assert got[i].edited_fingerprint == of[edited]
            bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
            assert got[i].near_edited == bits(got[i].fingerprint, got[i].edited_fingerprint)
            assert got[i].near_next == bits(got[i].fingerprint, got[rows[(k + 1) % len(rows)][0]].fingerprint)


def test_long_texts_keep_their_votes(spark):
    t = "extraordinarily elongated " * 20_000
    a, b = G.edited_fingerprints(frame(spark, [(1, t), (2, t)])).orderBy("doc_id").collect()
    assert a.fingerprint == b.fingerprint and a.near_edited == 1.0


def test_within_radius_equals_brute_force(spark):
    r = random.Random(7)
    base = [r.getrandbits(128) for _ in range(40)]
    values = base + [x ^ sum(1 << b for b in r.sample(range(128), r.randrange(0, 8))) for x in base for _ in range(3)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(k, signed(v >> 64), signed(v & (1 << 64) - 1)) for k, v in enumerate(values)], "doc_id long, hi long, lo long")
    queries = df.where("doc_id % 10 = 0")
    got = {(x["query"], x.doc_id): x.distance for x in G.within_radius(queries, df, 3).collect()}
    want = {(q, k): (values[q] ^ v).bit_count() for q in range(0, len(values), 10) for k, v in enumerate(values) if (values[q] ^ v).bit_count() <= 3}
    assert got == want


def test_the_query_searches_the_block_tables(spark):
    r = random.Random(11)
    base = "".join(r.choice("abcdefghij ") for _ in range(4000))
    rows = []
    for k in range(60):
        at = r.randrange(len(base))
        rows.append((k * 50 + 50, base if k % 5 == 0 else base[:at] + "x" * (k % 7) + base[at:]))
    rows += [(7000 + k, "".join(r.choice("klmnopqr ") for _ in range(300))) for k in range(20)]
    got = G.edited_fingerprints(frame(spark, rows), radius=3, asked=lambda i: i % 100 == 0).collect()
    prints = {x.doc_id: int(x.fingerprint, 16) for x in got}
    assert len(prints) == len(rows)
    want = {i: sum((p ^ q).bit_count() <= 3 for q in prints.values()) - 1 if i % 100 == 0 else None for i, p in prints.items()}
    assert {x.doc_id: x.n_within for x in got} == want
    assert len(set(want.values())) > 3


def test_edges(spark):
    for name, df in edge_frames(spark).items():
        n = df.count()
        assert N.near_duplicates(df).count() == n, name
        assert S.remove_repeats(df).count() == n, name
        assert G.edited_fingerprints(df).count() == n, name
        asked = G.edited_fingerprints(df, asked=lambda i: i % 100 == 0)
        assert asked.count() == n and asked.where(F.col("doc_id").isNull() & F.col("n_within").isNotNull()).count() == 0, name
    twice = frame(spark, [(1, "one two three four five six")] * 3)
    assert N.keep_one_of_each(twice).count() == 1
    null = N.near_duplicates(frame(spark, [(None, "a b c d"), (7, "a b c d"), (None, "q")])).collect()
    assert sorted((r.component_id for r in null), key=str) == [7, 7, None]
    # a null id loses bytes but takes none
    passage = "p" * 30 + "q" * 40
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(frame(spark, [(None, passage), (3, passage), (4, passage)])).collect()}
    assert got == {None: 70, 3: 0, 4: 70}
