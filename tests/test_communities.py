"""Communities by modularity against a plain one-node-at-a-time search, planted groups and odd graphs."""

import os
import random
from collections import defaultdict

import pytest

from lithoframe.operators import communities as M
from lithoframe.operators import graph as G

DATA = "/root/testdata/sf0.001"


def modularity(edges, label):
    total, inside, degree = 0.0, 0.0, defaultdict(float)
    for a, b, w in edges:
        total += w
        inside += w * (label[a] == label[b])
        degree[label[a]] += w
        degree[label[b]] += w
    return inside / total - sum(d * d for d in degree.values()) / (4 * total * total)


def plain(edges, seed=1):
    """Greedy moves one node at a time, then the same on the merged graph, until nothing moves."""
    r, near, loops = random.Random(seed), defaultdict(lambda: defaultdict(float)), defaultdict(float)
    for a, b, w in edges:
        near[a][b] += w
        near[b][a] += w
    place, doubled = {n: n for n in near}, 2 * sum(w for *_, w in edges)
    while True:
        k = {n: sum(near[n].values()) + 2 * loops[n] for n in near}
        label, tot, changed, again = {n: n for n in near}, dict(k), False, True
        while again:
            again = False
            for n in sorted(near, key=lambda _: r.random()):
                pull = defaultdict(float)
                for other, w in near[n].items():
                    pull[label[other]] += w
                tot[label[n]] -= k[n]
                gain = lambda c: pull.get(c, 0.0) - k[n] * tot[c] / doubled  # noqa: B023, E731
                best = max(pull, key=gain, default=label[n])
                if gain(best) > gain(label[n]) + 1e-9:
                    label[n], again, changed = best, True, True
                tot[label[n]] += k[n]
        if not changed:
            return place
        place = {n: label[p] for n, p in place.items()}
        merged, own = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a in near:
            own[label[a]] += loops[a]
            merged[label[a]]
            for b, w in near[a].items():
                if label[a] == label[b]:
                    own[label[a]] += w / 2
                else:
                    merged[label[a]][label[b]] += w
        near, loops = merged, own


def planted(groups=8, size=12, seed=4):
    r = random.Random(seed)
    nodes = [f"n{k:03d}" for k in range(groups * size)]
    edges = []
    for i in range(len(nodes)):
        for j in range(i):
            if r.random() < (0.5 if i // size == j // size else 0.015):
                edges.append((nodes[i], nodes[j], r.randrange(1, 4)))
    return edges


def run(spark, edges, least=1):
    return {r.node: r.cluster for r in M.communities(spark.createDataFrame(edges, "a string, b string, weight long"), least).collect()}


def test_planted_groups_are_found_whatever_the_order_of_rows(spark):
    edges = planted()
    got = run(spark, edges)
    assert modularity(edges, got) >= modularity(edges, plain(edges)) - 0.02
    assert modularity(edges, got) >= modularity(edges, {n: int(n[1:]) // 12 for n in got})
    shuffled = [(b, a, w) for a, b, w in edges]
    random.Random(9).shuffle(shuffled)
    assert run(spark, shuffled) == got


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_fact_graph_reaches_the_plain_search(spark):
    from lithoframe.plans import fact_graph

    e = M.materialize(fact_graph._weak_edges(spark, DATA), "e")
    edges = [tuple(r) for r in e.select("a", "b", "weight").collect()]
    got = M.materialize(M.communities(e, 1), "c")
    label = {r.node: r.cluster for r in got.collect()}
    worth = modularity(edges, label)
    assert worth >= modularity(edges, plain(edges)) - 0.02
    spread = {r.node: r.cluster for r in G.clusters(e, least=1).collect()}
    assert worth >= modularity(edges, spread)
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    for cluster in set(label.values()):
        own = {n for n, c in label.items() if c == cluster}
        assert min(own) == cluster
        seen, todo = set(), [cluster]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near[n] & own
        assert seen == own
    strength = defaultdict(int)
    for a, b, w in edges:
        strength[a] += w
        strength[b] += w
    want = {(c, ", ".join(sorted((n for n, x in label.items() if x == c), key=lambda n: (-strength[n], n))[:3])) for c in set(label.values())}
    assert {(r.cluster, r.title) for r in M.titles(e, got).collect()} == want


def test_odd_graphs(spark):
    assert run(spark, []) == {}
    odd = [("a", "b", 1), ("b", "a", 2), ("a", "a", 5), ("c", "c", 1), (None, "a", 1), ("d", "e", 0), ("x", "y", 3), ("y", "z", 3)]
    got = run(spark, odd + [("hub", f"h{k}", 1) for k in range(30)])
    assert {n: c for n, c in got.items() if n[0] != "h"} == {"a": "a", "b": "a", "c": "c", "x": "x", "y": "x", "z": "x"}
    assert {c for n, c in got.items() if n[0] == "h"} == {"h0"}
