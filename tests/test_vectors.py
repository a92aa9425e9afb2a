"""The vector index, block joins, the cosine join and name merging against plain versions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.operators import cosine_join as C
from lithoframe.operators import sparse_join as SJ
from lithoframe.operators import linking as L
from lithoframe.operators import vector_index as V
from lithoframe.operators.search import vector_search
from lithoframe.plans.scratch import new_path

DATA = "/root/testdata/sf0.01"
VECTORS = "id long, doc_id int, embedding array<float>"


def cloud(n=900, dim=24, groups=30, seed=3, spread=0.25):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, dim))
    x = centres[r.integers(0, groups, n)] + spread * r.standard_normal((n, dim))
    return [(k, k % 7, v) for k, v in enumerate(x.astype(np.float32).tolist())]


def unit(rows):
    x = np.array([r[2] for r in rows], np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def index(spark):
    rows = [*cloud(), (2000, 1, None), (2001, 1, [0.0] * 24), (2002, 1, [1.0])]
    return V.build_index(spark.createDataFrame(rows, VECTORS), new_path(spark, "test-index"))


def test_every_row_is_stored_once(index):
    stored = index.rows().select("id", "cell").collect()
    assert sorted(r.id for r in stored) == [*range(900), 2000, 2001, 2002]
    assert {r.id for r in stored if r.cell == -1} == {2000, 2001, 2002}
    assert index.sizes.sum() == 900 and len(index.centroids) == 30


def test_search_reads_only_the_probed_cells(spark, index):
    cells = index.bounds(cloud()[0][2])[0][:2].tolist()
    plan = index.rows().where(F.col("cell").isin(cells))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    read = index.rows().where(F.col("cell").isin(cells)).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r.f.split("cell=")[1].split("/")[0]) for r in read} == set(cells)


def test_exact_search_equals_a_scan_and_prunes(spark, index):
    df = spark.createDataFrame(cloud(), VECTORS)
    for at in (0, 123, 700):
        v = cloud()[at][2]
        want = [tuple(r) for r in vector_search(df, v, 12).collect()]
        assert [tuple(r) for r in index.search(v, 12, exact=True, probes=1).select("id", "doc_id", "similarity", "pos").collect()] == want
        some = [tuple(r) for r in vector_search(df.where("doc_id = 3 AND id > 400"), v, 12).collect()]
        assert [tuple(r) for r in index.search(v, 12, where=F.expr("doc_id = 3 AND id > 400"), exact=True).select("id", "doc_id", "similarity", "pos").collect()] == some


def test_a_filter_makes_the_search_read_on(spark, index):
    rare = index.search(cloud()[5][2], 10, where=F.col("id").isin(list(range(0, 900, 60))), probes=1)
    assert rare.count() == 10
    assert index.search(cloud()[5][2], 10, where=F.lit(False)).count() == 0


def test_recall_of_single_and_joined_searches(spark, index):
    rows = cloud()
    x = unit(rows)
    s = x @ x.T
    asked = spark.createDataFrame(rows, VECTORS).where("id % 10 = 0")
    got = {}
    for r in index.neighbours(asked, 10).collect():
        got.setdefault(r.q, set()).add(r.i)
    np.fill_diagonal(s, -2)
    true = {q: set(np.argsort(-s[q])[:10].tolist()) for q in range(0, 900, 10)}
    assert set(got) == set(true) and all(len(v) == 10 for v in got.values())
    assert sum(len(got[q] & true[q]) for q in true) / (10 * len(true)) >= 0.9
    one = {r.id for r in index.search(rows[50][2], 11).collect()} - {50}
    assert len(one & true[50]) >= 8
    assert index.probes < len(index.centroids)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_recall_on_the_tables(spark):
    """Ids divisible by 100 against every row, at ten neighbours."""
    from lithoframe.plans import catalog

    rows = [(r.vec_id, 0, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    ids, x = np.array([r[0] for r in rows]), unit(rows)
    found = total = 0
    got = {}
    for r in catalog.queries()["index_neighbours"](spark, DATA).collect():
        got.setdefault(r.q, set()).add(r.i)
    for k in np.flatnonzero(ids % 100 == 0):
        s = x @ x[k]
        s[k] = -2
        found += len(set(ids[np.argsort(-s)[:10]].tolist()) & got[ids[k]])
        total += 10
    assert found / total >= 0.9


def test_a_stored_index_opens_again(spark, index):
    again = V.open_index(spark, index.path)
    assert again.probes == index.probes and (again.sizes == index.sizes).all() and np.allclose(again.centroids, index.centroids)


def test_small_and_empty_indexes(spark):
    none = V.build_index(spark.createDataFrame([(1, 1, None)], VECTORS), new_path(spark, "empty"))
    assert none.search([1.0, 0.0], 3).count() == 0
    one = V.build_index(spark.createDataFrame([(1, 1, [1.0, 2.0])], VECTORS), new_path(spark, "one"))
    assert [r.id for r in one.search([1.0, 0.0], 3).collect()] == [1]
    same = V.build_index(spark.createDataFrame([(k, 1, [1.0, 2.0]) for k in range(50)], VECTORS), new_path(spark, "same"))
    assert [r.id for r in same.search([1.0, 2.0], 3).collect()] == [0, 1, 2]


def test_block_joins_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 70)
    monkeypatch.setattr(V, "QUERIES", 30)
    monkeypatch.setattr(C, "CROWD", 80)
    rows = cloud(300)
    df, x = spark.createDataFrame(rows, VECTORS).withColumn("embedding", F.expr("transform(embedding, e -> CAST(e AS DOUBLE))")), np.array([r[2] for r in rows], np.float64)
    got = {(r.q, r.pos): (r.i, r.similarity) for r in V.knn_join(df.where("id < 100"), df, 4).collect()}
    s = np.round(x[:100] @ x.T, 6)
    want = {(q, n): (i, s[q, i]) for q in range(100) for n, i in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-s[q, i], i))[:4], 1)}
    assert got == want
    s = np.round(unit(rows) @ unit(rows).T, 6)
    want = {(a, b, s[a, b]) for a in range(300) for b in range(a + 1, 300) if s[a, b] >= 0.6}
    assert {tuple(r) for r in C.exact_join(df, 0.6).collect()} == want


def test_cosine_join_finds_pairs_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "CROWD", 20)
    rows = cloud(1500, groups=150, spread=0.35) + [(5000 + k, 0, cloud()[0][2]) for k in range(200)] + [(9000, 0, None), (9001, 0, [0.0] * 24)]
    df = C.materialize(C.distinct_vectors(spark.createDataFrame(rows, VECTORS)), "distinct")
    assert df.agg(F.sum("members"), F.max("members")).first()[:] == (1701, 200)
    x = unit(rows[:1500])
    s = np.round(x @ x.T, 6)
    true = {(a, b) for a, b in zip(*np.nonzero(np.triu(s >= 0.8, 1)))}
    got = {(r.a, r.b): r.similarity for r in C.cosine_join(df, 0.8).collect()}
    inside = {p for p in got if p[1] < 1500}
    assert inside <= true and len(inside) / len(true) >= 0.99
    assert all(abs(got[p] - s[p]) < 1e-5 for p in inside)
    met = C.candidates(df, 0.8, 0.1).count()
    assert met < 1500 * 1500 / 2 / 8


def test_bands_follow_rows_and_recall():
    assert C.plan_bands(64 * 2**20, 0.8, 0.1)[0] == 20
    for rows in (100, 10**5, 10**9):
        bits, bands = C.plan_bands(rows, 0.8, 0.01)
        agree = (1 - np.arccos(0.8) / np.pi) ** bits
        assert (1 - agree) ** bands <= 0.01 < (1 - agree) ** (bands - 2)


def test_names_follow_more_frequent_ones(spark):
    names = [("gold ore", 9), ("gold ores", 5), ("gold oress", 2), ("ore 12", 8), ("ore 13", 3), ("alone", 1)]
    pairs = [("gold ore", "gold ores", 0.9), ("gold ores", "gold oress", 0.95), ("gold ore", "gold oress", 0.8), ("ore 12", "ore 13", 0.99)]
    got = C.merge_names(spark.createDataFrame([(n, n, t) for n, t in names], "id string, name string, times long"), spark.createDataFrame(pairs, "a string, b string, similarity double"), L.merge_guard(F.col("name"), F.col("other")))
    assert {r.id: (r.canon, r.similarity) for r in got.collect()} == {
        "gold ore": ("gold ore", None), "gold ores": ("gold ore", 0.9), "gold oress": ("gold ore", 0.95), "ore 12": ("ore 12", None), "ore 13": ("ore 13", None), "alone": ("alone", None),
    }


def test_a_long_chain_of_names(spark):
    r = random.Random(2)
    n = 300
    times = sorted((r.randrange(1, 10**6) for _ in range(n)), reverse=True)
    names = spark.createDataFrame([(k, f"n{'x' * k}", t) for k, t in enumerate(times)], "id long, name string, times long")
    pairs = spark.createDataFrame([(k, k + 1, 0.9) for k in range(n - 1)], "a long, b long, similarity double")
    assert {x.canon for x in C.merge_names(names, pairs, F.lit(True)).collect()} == {0}


@pytest.mark.parametrize("level", [1, 2, 3, 4])
def test_sparse_join_finds_every_pair_in_small_buckets(spark, monkeypatch, level):
    """Like names, long and very short ones, crowded buckets and values that are no whole numbers."""
    monkeypatch.setattr(SJ, "plan_level", lambda rows, width: level)
    monkeypatch.setattr(SJ, "SMALL", 3)
    r = np.random.default_rng(level)
    for whole, crowd in ((True, 4), (False, 2048)):
        monkeypatch.setattr(SJ, "CROWD", crowd)
        x = np.zeros((260, 40))
        for k in range(260):
            if k % 3 or k < 3:
                x[k, r.choice(40, r.integers(1, 16), replace=False)] = r.integers(1, 4, 1)
                x[k, r.integers(40)] += r.integers(0, 3)
            else:
                x[k] = x[k - 2]
                x[k, r.integers(40)] += 1
        x = x if whole else x * r.choice([-1.0, 1.5], (1, 40)) + 0.0
        x[259] = 0
        n = np.sqrt((x * x).sum(1))
        with np.errstate(invalid="ignore"):
            s = np.nan_to_num(np.round(x @ x.T / n[:, None] / n, 6))
        want = {(a, b): s[a, b] for a, b in zip(*np.nonzero(np.triu(s >= 0.8, 1)))}
        rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None)], "id long, v array<double>").repartition(3)
        got = [tuple(p) for p in SJ.sparse_join(rows, 0.8).collect()]
        assert len(got) == len(want) > 50 and {p[:2]: p[2] for p in got} == pytest.approx(want)
    assert SJ.sparse_join(rows.limit(0), 0.8).count() == 0


def test_sparse_join_makes_few_buckets_of_a_name():
    """Of 17 dimensions of one weight, as a name has, three of the nine rarest make a bucket; like names share eleven at least."""
    lengths, own, need = SJ.prefixes(np.full((1, 17), 1 / 17), np.array([17]), 0.8, 3)
    assert lengths.tolist() == [[7, 8, 9]] and own.tolist() == [3] and need.tolist() == [11]
    assert [SJ.plan_level(n, 256) for n in (100, 250_000, 10**6, 10**7)] == [1, 2, 3, 4]


def test_names_meet_without_bands_of_signs(spark, monkeypatch):
    """Trigram counts are all positive, so their signs fill few buckets; both queries of names take the exact join."""
    from lithoframe.plans import vectors

    monkeypatch.setattr(C, "candidates", lambda *a: pytest.fail("bands of signs"))
    for q in (vectors.similar_spellings, vectors.name_synonyms):
        assert q(spark, "/root/testdata/sf0.001").count() >= 0
