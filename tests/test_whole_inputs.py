"""Queries without a statement reach every row of their input, against plain versions."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lithoframe.plans import catalog
from lithoframe.plans.views import facts

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_graph_clusters_take_every_fact(spark):
    documents = defaultdict(set)
    for r in facts(spark, DATA).select("src", "dst", "doc_id").collect():
        documents[r.src, r.dst].add(r.doc_id)
    near = defaultdict(list)
    for (a, b), docs in documents.items():
        near[a].append((b, len(docs)))
        near[b].append((a, len(docs)))
    names = spark.createDataFrame([(n,) for n in near], "n string").select("n", F.hash("n").alias("h"))
    place = {r.n: r.h for r in names.collect()}
    label = {n: n for n in near}
    for _ in range(8):
        after = {}
        for n, others in near.items():
            # the half vote for a node's own label is cut to the votes' whole numbers
            votes = Counter({label[n]: 0})
            for other, weight in others:
                votes[label[other]] += weight
            after[n] = max(votes, key=lambda x: (votes[x], place[x], x))
        same, label = after == label, after
        if same:
            break
    sizes = Counter(label.values())
    want = {(n, c, sizes[c]) for n, c in label.items() if sizes[c] >= 3}
    got = [tuple(r) for r in catalog.queries()["graph_clusters"](spark, DATA).select("node", "cluster", "size").collect()]
    assert len(got) == len(set(got)) and set(got) == want
