"""Links by shared chunks against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lithoframe.operators import minhash as M


@pytest.mark.parametrize("sharers", [1, 2, 64])
def test_families_are_those_of_all_pairs(spark, monkeypatch, sharers):
    monkeypatch.setattr(M, "SHARERS", sharers)
    for seed in range(3):
        r = random.Random(seed)
        docs = {}
        for d in range(140):
            lines = {f"own {d} {k}" for k in range(r.randrange(8))} | {f"pair {d // 2}" for _ in range(r.randrange(2))} | {f"line {r.randrange(8)}" for _ in range(r.randrange(4))}
            docs[d] = (lines, max(1, len(lines) + r.randrange(3)))
        of = {d: d for d in docs}

        def find(d):
            while of[d] != d:
                d = of[d]
            return d

        for a in docs:
            for b in range(a):
                n = len(docs[a][0] & docs[b][0])
                if n and n / min(docs[a][1], docs[b][1]) >= 0.3:
                    x, y = find(a), find(b)
                    of[max(x, y)] = min(x, y)
        items = spark.createDataFrame([(d, h) for d, (lines, _) in docs.items() for h in lines], "doc_id long, h string")
        sizes = spark.createDataFrame([(d, n) for d, (_, n) in docs.items()], "doc_id long, chunks long")
        got = {x.doc_id: x.family for x in M.source_families(None, sizes, [M.sharing_links(items, sizes)]).collect()}
        assert got == {d: find(d) for d in docs} and 5 < len(set(got.values())) < 135


def test_a_common_chunk_makes_no_pairs(spark):
    """3,000 documents of one line, of which 1,500 have only that: fewer links than twice the documents, not 4,498,500."""
    items = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("line").alias("h"))
    sizes = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 1).otherwise(9).cast("long").alias("chunks"))
    links = M.sharing_links(items, sizes)
    assert 2999 <= links.count() < 6000
    assert {x.family for x in M.source_families(None, sizes, [links]).select("family").distinct().collect()} == {0}
