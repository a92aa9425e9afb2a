"""Documents that share authors against all pairs."""

import random

import pytest

from lithoframe.operators import linking as L


@pytest.mark.parametrize(("wide", "least"), [(32, 0.5), (3, 0.5), (0, 0.5), (32, 0.34), (4, 0.8), (32, 0.01)])
def test_author_overlap_equals_all_pairs(spark, monkeypatch, wide, least):
    monkeypatch.setattr(L, "WIDE", wide)
    r = random.Random(8)
    docs = {d: [r.choice([None, *range(14)]) for _ in range(r.randrange(9))] for d in range(90)}
    want = {}
    for b in docs:
        for a in range(b):
            n = len((set(docs[a]) & set(docs[b])) - {None})
            if n and n / min(len(set(docs[a])), len(set(docs[b]))) >= least:
                want[a, b] = n / min(len(set(docs[a])), len(set(docs[b])))
    df = spark.createDataFrame([*docs.items(), (500, None)], "doc_id long, authors array<int>")
    got = [tuple(x) for x in L.author_overlap(df, least).collect()]
    assert len(got) == len(want) > 50 and {x[:2]: x[2] for x in got} == pytest.approx(want)


def test_pairs_of_few_authors_are_not_shuffled(spark):
    """The only exchange is that of a document's rows by author; no pair goes through one."""
    df = spark.createDataFrame([(d, [d % 7, d % 5 + 10, d % 3 + 20]) for d in range(300)], "doc_id long, authors array<int>").repartition(4)
    done = L.author_overlap(df)
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.split("Initial Plan")[0].count("hashpartitioning(x_doc_id") == 0
