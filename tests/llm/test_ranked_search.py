"""Block-max search against brute force: results, cuts, bounds, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lithoframe.llm import ranked_search as R
from tests.llm.corpus import documents, edge_frames, frame, sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, queries, k=20):
    found = [(i, Counter(terms(t))) for i, t in rows]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    docs, total = len(found), sum(n for _, _, n in found)
    holding = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c, n in found:
            m = 75 + 25 * n * docs // total
            s = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s:
                scored.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def asked(n=12):
    r = random.Random(3)
    return [(k, sentence(r, r.randrange(1, 30))) for k in range(n)] + [(50, ""), (51, None), (52, "Capital, capital CAPITAL words."), (53, "日本語のテキスト é"), (54, "nowhere")]


def run(spark, rows, queries, k=20):
    out = R.best_matches(frame(spark, rows), spark.createDataFrame(queries, "item_id long, text string"), k)
    return sorted(tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("shard_docs", [5, 8192])
def test_results_equal_brute_force(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(R, "SHARD_DOCS", shard_docs)
    rows = documents(120)
    for k in (1, 20):
        assert run(spark, rows, asked(), k) == brute(rows, asked(), k)


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_CHARS", 100)
    rows = documents(30)
    assert run(spark, rows, asked()) == brute(rows, asked())


def test_a_very_long_text_and_ties(spark):
    rows = [(k, "same words here") for k in range(60)] + [(99, "other " * 200_000 + "rare"), (100, "rare")]
    queries = [(1, "same"), (2, "rare other"), (3, "rare rare")]
    got = run(spark, rows, queries)
    assert got == brute(rows, queries)
    assert [r[2] for r in got if r[0] == 1] == list(range(20))


def test_cuts_cost_least():
    r = np.random.default_rng(1)
    sizes = np.array([1, 9, 30, 2, 17])
    impacts = r.integers(1, 1000, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    begin = R.cut_blocks(impacts, starts, longest=6, price=700)
    for a, n in zip(starts.tolist(), sizes.tolist()):
        part = impacts[a : a + n].tolist()
        best = [0.0]
        for i in range(1, n + 1):
            best.append(min(best[i - j] + j * max(part[i - j : i]) + 700 for j in range(1, min(6, i) + 1)))
        own = [*begin[(begin >= a) & (begin < a + n)].tolist(), a + n]
        assert own[0] == a and max(np.diff(own)) <= 6
        assert sum((q - p) * max(impacts[p:q]) + 700 for p, q in zip(own, own[1:])) == best[n]


def test_bounds_hold_and_postings_are_skipped():
    r = np.random.default_rng(2)
    width, sizes = 4000, np.array([4000, 900, 300])
    docs = np.concatenate([np.sort(r.choice(width, n, replace=False)) for n in sizes])
    lengths = r.integers(20, 3000, width)
    counts = r.geometric(0.5, len(docs))
    counts[:40] = 50
    shard = R.Shard(sizes, docs, counts, lengths, width, int(lengths.sum()))
    which, weights = np.arange(3), np.array([300, 1500, 2600])
    true = shard.scores(np.arange(width), which, weights)
    assert (shard.bounds(which, weights) >= true).all()
    shard.scored = 0
    best, worth = shard.search(which, weights, 20)
    assert list(zip(-worth, best)) == sorted(zip(-true, range(width)))[:20]
    assert shard.scored < width / 3


def test_all_terms_can_be_indexed(spark):
    rows = documents(40)
    index = R.index_documents(frame(spark, rows))
    held = Counter()
    for r in index.collect():
        assert r.terms == sorted(r.terms) and sum(r.sizes) == len(r.docs) == len(r.counts)
        held.update(dict(zip(r.terms, r.sizes)))
    assert held == Counter(t for _, text in rows for t in set(terms(text)))
    got = R.search(index, [Counter(R.terms_of(b"ban kist"))], 5).count()
    assert got <= 5 * index.count()


def test_edges(spark):
    frames, queries = edge_frames(spark), spark.createDataFrame([(7, "some words one two")] * 2, "item_id long, text string")
    assert R.best_matches(frames["empty"], queries).count() == 0
    assert [(r["rank"], r.doc_id) for r in R.best_matches(frames["null_id"], queries).orderBy("rank").collect()] == [(1, 1), (2, None)]
    assert [(r["rank"], r.doc_id) for r in R.best_matches(frames["repeated"], queries).orderBy("rank").collect()] == [(1, 1), (2, 1), (3, 1)]
    assert R.best_matches(frames["clash"], queries).columns == ["item_id", "rank", "doc_id", "score"]
    assert R.best_matches(frames["clash"], queries.where("false")).count() == 0
    named = spark.createDataFrame([("b", "one two"), ("a", "one two")], "doc_id string, text string")
    assert [r.doc_id for r in R.best_matches(named, spark.createDataFrame([("q", "two")], "item_id string, text string")).orderBy("rank").collect()] == ["a", "b"]
