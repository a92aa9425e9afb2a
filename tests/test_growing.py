"""Growing indexes: batches give what all rows at once give, and read only what is new."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lithoframe.operators import minhash as M
from lithoframe.operators.components import connected_components
from lithoframe.operators.growing import ComponentIndex, CopyIndex
from lithoframe.plans.scratch import new_path

DATA = "/root/testdata/sf0.001"


def texts(n=90, seed=6):
    r, out = random.Random(seed), []
    for k in range(n):
        if k % 3 and k > 5:
            w = out[r.randrange(len(out))].split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        else:
            w = [f"w{r.randrange(10**6)}" for _ in range(r.choice([10, 60, 120]))]
        out.append(" ".join(w))
    return list(enumerate(out)) + [(n, None), (n + 1, "")]


def brute(spark, rows, least=0.8):
    """One row after the other, on the same signatures."""
    df = spark.createDataFrame(rows, "id long, text string")
    sigs = {r.id: r.sig for r in M.sign_long(df, "id", "text", 20).collect()}
    kept, out = [], {}
    for k in sorted(sigs):
        near = [] if sigs[k] is None else [(-sum(a == b for a, b in zip(sigs[k], sigs[x])) / 64, x) for x in kept if any(sigs[k][i : i + 4] == sigs[x][i : i + 4] for i in range(0, 64, 4))]
        near = [x for x in near if -x[0] >= least]
        out[k] = min(near)[1] if near else None
        if not near and sigs[k] is not None:
            kept.append(k)
    return out


def batches(rows, cuts):
    edges = [0, *cuts, len(rows)]
    return [rows[a:b] for a, b in zip(edges, edges[1:])]


def test_near_copies_in_batches(spark, monkeypatch):
    monkeypatch.setattr(M, "CROWD", 3)
    rows = texts()
    want = brute(spark, rows)
    frame = lambda part: spark.createDataFrame(part, "id long, text string")
    assert {r.id: r.original for r in M.near_duplicates(frame(rows)).collect()} == want
    assert len({v for v in want.values() if v is not None}) > 5
    for cuts in ([20, 21, 60],):
        path, got = new_path(spark, "copies-test"), {}
        for part in batches(rows, cuts):
            index = CopyIndex(spark, path, buckets=4)
            got |= {r.id: r.original for r in index.add(frame(part)).collect()}
        assert got == want
        stored = spark.table(index.bands)
        assert {r.id for r in stored.select("id").distinct().collect()} == {k for k, v in want.items() if v is None and k < len(rows) - 2 and len(rows[k][1].split(" ")) >= 20}
        assert stored.count() == 16 * stored.select("id").distinct().count()


def test_the_stored_side_is_read_in_place(spark):
    path = new_path(spark, "plan-test")
    index = CopyIndex(spark, path, buckets=4)
    index.add(spark.createDataFrame(texts(30), "id long, text string"))
    reps = M.materialize(spark.createDataFrame([(100, list(range(64)))], "id long, sig array<long>"), "reps")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.matches(reps)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    join = plan[plan.index("SortMergeJoin") :]
    assert "Bucketed: true" in join and join.count("Exchange hashpartitioning(band") == 1


def test_components_in_batches(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(150):03d}", f"n{r.randrange(150):03d}") for _ in range(130)] + [("a", "a"), (None, "n001"), ("n001", None)]
    edges += [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(0, 30)]
    r.shuffle(edges)
    path, so_far = new_path(spark, "components-test"), []
    for part in [*batches(edges, [40, 100]), edges[:10], []]:
        index = ComponentIndex(spark, path, buckets=4)
        index.add(spark.createDataFrame(part, "a string, b string"))
        so_far += part
        want = {tuple(x) for x in connected_components(spark.createDataFrame(so_far, "a string, b string")).collect()}
        got = [tuple(x) for x in index.current().collect()]
        assert len(got) == len(set(got)) and set(got) == want
    files = {f.split("/")[-1] for f in spark.table(index.nodes).inputFiles()}
    index.add(spark.createDataFrame([("n001", "z1")], "a string, b string"))
    assert files <= {f.split("/")[-1] for f in spark.table(index.nodes).inputFiles()}
    added = [f for f in spark.table(index.nodes).inputFiles() if f.split("/")[-1] not in files]
    assert spark.read.parquet(*added).count() == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_documents_in_batches_equal_one_pass(spark):
    from lithoframe.plans import catalog

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    want = {r.id: r.original for r in M.near_duplicates(docs).collect()}
    assert {r.id: r.original for r in catalog.queries()["growing_near_duplicates"](spark, DATA).collect()} == want
    assert want == brute(spark, [tuple(r) for r in docs.collect()])
