"""Operators, sources, sinks and streams on small frames."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lithoframe.operators import evidence as E
from lithoframe.operators import facts as K
from lithoframe.operators import graph as G
from lithoframe.operators import minhash as M
from lithoframe.operators import search as S
from lithoframe.operators import statistics as T
from lithoframe.operators import tables as B
from lithoframe.operators import upkeep as U
from lithoframe.operators import words as W
from lithoframe.operators.components import connected_components
from lithoframe.plans import scratch
from lithoframe.sources import api, files, sinks


def test_components_equal_brute_force(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            of[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in of}
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_accepted_facts(spark):
    rows = [(1, 10, "a", "b", None, False), (2, 11, "b", "a", 0, False), (3, 10, "c", "d", 3, False), (4, 10, "e", "f", 2, False), (5, 12, "e", "f", None, True)]
    df = spark.createDataFrame(rows, "id long, doc_id long, src string, dst string, votes int, stale boolean")
    accepted = lambda **k: {r.id for r in K.with_accepted(df, **k).where("accepted").collect()}
    assert accepted() == {1, 2, 3, 4, 5}
    assert accepted(fresh=True) == {1, 2, 3}
    assert accepted(min_votes=4) == {1, 2, 4, 5}


def test_hybrid_search_falls_back_to_any_word(spark):
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 1, [1.0, 1.0]), (4, 2, [0.0, 0.0])], "id long, doc_id long, embedding array<double>")
    texts = spark.createDataFrame([(1, 1, "red fox"), (2, 1, "blue bird"), (4, 2, "red bird")], "id long, doc_id long, text string")
    got = S.hybrid_search(vectors, texts, [1.0, 0.0], ["red", "blue", "green"], max_per_doc=2).orderBy("place").collect()
    assert [r.id for r in got] == [1, 2, 4, 3]  # the third of document 1 comes last
    assert [r.found_by for r in got] == ["both", "both", "text", "vector"]
    only = S.hybrid_search(vectors, texts, [1.0, 0.0], ["red"], require_words=True).collect()
    assert {r.id for r in only} == {1, 4}


def test_closure_stops_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "child string, parent string")
    got = {(r.child, r.ancestor) for r in G.closure(edges).collect()}
    assert got == {(p, q) for p in "abc" for q in "abc"} | {("x", q) for q in "abc"}
    assert {r.area for r in E.integrity(edges).where("problem = 'CYCLE'").collect()} == set("abc")


def test_clusters_find_cliques(spark):
    a = [(f"a{i}", f"a{j}", 5) for i in range(4) for j in range(i)]
    b = [(f"b{i}", f"b{j}", 5) for i in range(4) for j in range(i)]
    found = G.clusters(spark.createDataFrame([*a, *b, ("a0", "b0", 1)], "a string, b string, weight long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.cluster, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[f"a{k}" for k in range(4)], [f"b{k}" for k in range(4)]]


def test_canonical_facts(spark):
    f = spark.createDataFrame([(1, "au", "formed by", "x"), (2, "gold", "in", "au"), (3, "q", "in", "x")], "id long, src string, relation string, dst string")
    names = spark.createDataFrame([("au", "gold")], "key string, canon string")
    relations = spark.createDataFrame([("formed by", "forms", True)], "relation string, canon_relation string, flip boolean")
    got = {(r.id, r.src, r.relation, r.dst) for r in G.canonicalise(f, names, relations).collect()}
    assert got == {(1, "x", "forms", "gold"), (3, "q", "in", "x")}


def test_first_kept_is_greedy_in_order(spark):
    r = random.Random(2)
    pairs = {(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(60)) if a < b}
    kept = []
    for b in range(40):
        if not any((a, b) in pairs for a in kept):
            kept.append(b)
    nodes = spark.range(40)
    got = M.first_kept(nodes, spark.createDataFrame(sorted(pairs), "a long, b long")).where("kept").collect()
    assert {r.id for r in got} == set(kept)


def test_minhash_estimates(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:190] + ["x"] * 10)), (3, " ".join(words)), (4, "too short"), (5, " ".join(reversed(words))), (6, None)]
    got = {r.id: r.original for r in M.near_duplicates(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None, 5: None, 6: None}


@pytest.mark.parametrize(("k", "n", "lo", "hi"), [(0, 10, 0.0, 0.2775), (5, 10, 0.2366, 0.7634), (10, 10, 0.7225, 1.0)])
def test_wilson(spark, k, n, lo, hi):
    a, b = T.wilson(F.lit(k), F.lit(n))
    r = spark.range(1).select(F.round(a, 4).alias("a"), F.round(b, 4).alias("b")).first()
    assert (abs(r.a), r.b) == (lo, hi)


def test_binomial_and_auc(spark):
    one = lambda k, n: spark.range(1).select(T.binomial_two_sided(F.lit(k), F.lit(n)).alias("p")).first().p
    assert one(1, 1) == 1.0 and abs(one(9, 10) - 0.021484375) < 1e-12 and one(0, 0) == 1.0
    df = spark.createDataFrame([(1.0, True), (2.0, False), (2.0, True), (3.0, True)], "s double, p boolean")
    assert T.auc(df, "s", "p").first().auc == 0.5


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 25).alias("c"), (F.col("id") % 7).cast("double").alias("v"))
    a, b = T.bootstrap_mean(df.repartition(1), "v", "c").first(), T.bootstrap_mean(df.repartition(7), "v", "c").first()
    assert a == b and a.lo < a.mean < a.hi


def test_decisions(spark):
    base = dict(support="ENTAILED", accepted=True, target="t", relation="EXACT", ambiguous=False, mixed=False, analogies=False, shared=False, deposit_ok=True, polarity="AFFIRM", want_polarity="AFFIRM", modality="ASSERTED", want_mode="FACT", quantifier="ALL", want_quantifier="ANY", stage=None, want_stage=None, conflicting=False)
    cases = [
        ({}, "DIRECT"), ({"support": "PARTIAL"}, "UNRESOLVED"), ({"relation": None}, "UNRESOLVED"), ({"target": None, "relation": None}, "DIRECT"), ({"relation": "DISJOINT"}, "OUT_OF_SCOPE"), ({"relation": "DISJOINT", "analogies": True, "shared": True}, "ANALOG"),
        ({"relation": "DISJOINT", "analogies": True, "shared": True, "deposit_ok": None}, "OUT_OF_SCOPE"), ({"deposit_ok": False}, "OUT_OF_SCOPE"), ({"polarity": "NEGATE"}, "UNRESOLVED"), ({"modality": "HYPOTHESIS"}, "UNRESOLVED"), ({"modality": "HYPOTHESIS", "want_mode": "RESEARCH_REVIEW"}, "DIRECT"),
        ({"want_quantifier": "TYPICAL", "relation": "PART_OF"}, "UNRESOLVED"), ({"want_quantifier": "ALL"}, "DIRECT"), ({"want_stage": "late"}, "UNRESOLVED"), ({"want_stage": "Late", "stage": "late"}, "DIRECT"), ({"conflicting": True}, "UNRESOLVED"),
    ]
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in base.items())
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], kinds)
    status, _ = E.decide(E.POLICIES["full"])
    assert [r.s for r in df.select(status.alias("s")).collect()] == [s for _, s in cases]


def test_area_names_inside_longer_ones(spark):
    texts = spark.createDataFrame([(1, "North Delta and the Delta plain"), (2, "north delta only"), (3, "deltas")], "id long, text string")
    aliases = spark.createDataFrame([("A", "Delta"), ("B", "North Delta")], "area_id string, alias string")
    assert {(r.id, r.area_id) for r in E.find_areas(texts, aliases).collect()} == {(1, "A"), (1, "B"), (2, "B")}


def test_table_upkeep(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in B.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in B.replacement_plan(old, new, ["k"], "v").collect()} == {(1, "delete"), (2, "update"), (3, "insert")}
    assert B.table_fingerprint(old).first() == B.table_fingerprint(old.orderBy(F.desc("k"))).first() != B.table_fingerprint(new).first()
    done = spark.createDataFrame([(1, None), (2, "copy of 9"), (3, "copy of 1")], "id long, skipped string")
    assert {r.id for r in B.todo_with_retry(spark.range(1, 5), done, "id").collect()} == {2, 4}
    assert B.has_columns(B.add_columns(old, {"x": "int"}), ["k", "x"]) and not B.has_columns(B.drop_columns(old, ["v"]), ["v"])


def test_sources(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.chunks.json").write_text(json.dumps([{"doc_id": "a", "index": 0, "text": "x", "pages": [1]}]))
    (d / "b.chunks.json").write_text("{broken")
    (d / "c.chunks.json").write_text("[]")
    (d / "a.json").write_text(json.dumps({"title": "T"}))
    got = {r.file_id: (r.error, r.text) for r in files.chunk_files(spark, str(d)).collect()}
    assert got == {"a": (None, "x"), "b": ("unreadable", None), "c": ("empty", None)}
    assert [tuple(r) for r in files.document_files(spark, str(d), "title string").collect()] == [("a", "T")]
    (tmp_path / "j.jsonl").write_text('{"doc_id": "1", "s": "old"}\nbroken\n{"doc_id": "1", "s": "new"}\n')
    assert [tuple(r) for r in files.journal(spark, str(tmp_path / "j.jsonl"), "doc_id string, s string").collect()] == [("1", "new")]
    (tmp_path / "t.txt").write_text("# c\ngold\n\n iron \n")
    assert [r.term for r in files.term_list(spark, str(tmp_path / "t.txt")).collect()] == ["gold", "iron"]
    (tmp_path / "areas.csv").write_text("area_id,canonical_name,parent_ids\nA,Alpha,\nB,Beta,A; R\n")
    (tmp_path / "aliases.csv").write_text("alias,area_id\nalfa,A\n")
    areas, aliases, version = files.registry(spark, str(tmp_path / "areas.csv"), str(tmp_path / "aliases.csv"))
    assert {r.area_id: r.parent_ids for r in areas.collect()} == {"A": [], "B": ["A", "R"]} and aliases.count() == 1 and len(version) == 64
    (tmp_path / "s.jsonl").write_text('{"section": "names", "canon": "gold", "variants": ["Au"]}\n{"section": "names", "canon": "aurum", "variants": ["au"]}\n')
    assert {(r.key, r.canon, r.canons) for r in files.synonyms(spark, str(tmp_path / "s.jsonl")).collect()} == {("gold", "gold", 1), ("au", "gold", 2), ("aurum", "aurum", 1)}
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "q", "keywords": ["a | b", "c"]}\n')
    assert files.questions(spark, str(tmp_path / "q.jsonl")).first().keywords == [["a", "b"], ["c"]]
    one = files.folder(spark, str(d), "a.json").first()
    assert one.doc_id.startswith("a-") and len(one.sha256) == 64
    (tmp_path / "t.csv").write_text("Title of it,Year made\nx,1990\n")
    assert files.table_by_headers(spark, str(tmp_path / "t.csv"), {"title": "tit", "year": "year"}).first().asDict() == {"title": "x", "year": "1990"}


def test_api_source(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"p{n}.json").write_text(json.dumps({"results": [{"title": f"t{n}", "ids": [{"doi": "10/x"}]}]}))
    spark.dataSource.register(api.JsonApi)
    items = spark.read.format("json_api").options(url=f"file://{tmp_path}/p{{page}}.json", pages="2", items="results").load()
    assert {(r.title, r.doi) for r in api.pick_columns(items, {"title": "title", "doi": "doi|ids[].doi"}).collect()} == {("t1", "10/x"), ("t2", "10/x")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "id long, x array<string>")
    sinks.spreadsheet_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "csv").glob("part*"))
    assert text.startswith("﻿id;x\r\n") and "1;\"a; b\"" in text
    assert [json.loads(x) for x in sinks.event_lines(df)] == [{"id": 1, "x": ["a", "b"]}]
    sinks.dossier_files(spark.createDataFrame([(1, "direct")], "id long, section string"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d" / "json")).count() == 1


def test_closure_of_a_long_chain_is_whole(spark):
    n = 70
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(200, 201), (201, 200), (300, None)], "child int, parent int")
    got = {(r.child, r.ancestor): r.depth for r in G.closure(edges).where("child < 300").collect()}
    want = {(a, b): b - a for a in range(n) for b in range(a + 1, n + 1)}
    assert got == want | {(200, 201): 1, (201, 200): 1, (200, 200): 2, (201, 201): 2}


def test_first_kept_follows_a_chain_to_its_end(spark):
    n = 20
    nodes = spark.createDataFrame([(k,) for k in range(n)], "id int")
    pairs = spark.createDataFrame([(k, k + 1) for k in range(n - 1)], "a int, b int")
    assert {r.id for r in M.first_kept(nodes, pairs).where("kept").collect()} == set(range(0, n, 2))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Fake:
        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Fake)


def test_query_syntax():
    assert W.parse("gold veins") == W.Query((("gold",), ("veins",)))
    assert W.parse('"native gold" -silver ore', variants=lambda w: (w + "s",)) == W.Query((("ore", "ores"),), (("native", "gold"),), ("silver",))
    assert W.has_syntax('a "b c"') and W.has_syntax("a -b") and not W.has_syntax("well-known fact")
    assert W.parse("-a -b-c").excluded == ("a", "b", "c") and W.parse("").groups == ()


def test_index_search(spark):
    texts = ["native gold in a vein", "gold native", "native silver gold gold", "Native gold, native gold", "nothing", ""]
    index = W.word_index(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    found = lambda q, **k: [r.id for r in W.search_index(index, W.parse(q, **k), 10).collect()]
    assert found("gold native") == [3, 2, 0, 1]
    assert found('"native gold"') == [3, 0] and found("gold -silver -vein") == [3, 1]
    assert found("silver vein") == [] and found("silver vein", any_word=True) == [0, 2]
    assert found("golds", variants=lambda w: (w[:-1],)) == [2, 3, 0, 1] and found("") == [] and found("-gold") == []


def test_upkeep_of_nothing(spark):
    none = spark.createDataFrame([], "id long, chunk_id long, src string, relation string, dst string, text string")
    assert U.save_facts(none, none, none).count() == 0 and U.vector_changes(none, none).count() == 0
    null = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, text string")
    other = spark.createDataFrame([(1, None), (2, None), (4, "y")], "id int, text string")
    assert {tuple(r) for r in U.vector_changes(null, other).collect()} == {(2, "update"), (3, "insert"), (4, "delete")}
