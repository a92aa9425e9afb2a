"""Questions, model answers and layout on hand-made cases and against plain versions."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lithoframe.functions import text as X
from lithoframe.operators import answers as A
from lithoframe.operators import evidence as E
from lithoframe.operators import questions as Q
from lithoframe.operators import words as W
from tests.made import most_rows


def test_cover_density_equals_all_runs(spark):
    texts = {1: "gold in vein gold vein", 2: "gold a b c vein", 3: "vein", 4: "ore x gold vein ore gold", 5: ""}
    groups = [["gold"], ["vein", "veins"], ["ore"]]
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    index = W.word_index(df)
    for g in (groups, groups[:2], groups[:1]):
        want = {}
        for i, t in texts.items():
            w = t.split()
            runs = {(a, b) for a in range(len(w)) for b in range(a, len(w)) if all(set(w[a : b + 1]) & set(x) for x in g)}
            least = [r for r in runs if not any(s != r and s[0] >= r[0] and s[1] <= r[1] for s in runs)]
            if least:
                want[i] = round(sum(1 / (1 + b - a + 1 - len(g)) for a, b in least), 6)
        assert {r.id: r.score for r in W.cover_density(index, g, 10).collect()} == pytest.approx(want)


def test_entities_by_hint_and_by_the_longest_name(spark):
    names = spark.createDataFrame([("Gold Ridge", "gold ridge"), ("Gold Ridge", "zr-7"), ("ridge", "ridge"), ("Old Gold Ridge belt", "old gold ridge belt")], "entity string, spelling string")
    rows = [(1, "What is Gold Ridge?", None), (2, "the old gold ridge belt", None), (3, "nothing", "ZR 7"), (4, "about a ridge", "Silver Ridgeway"), (5, "about a ridge", "silver hills"), (6, None, None)]
    got = {r.id: r.entity for r in Q.resolve_entities(spark.createDataFrame(rows, "id int, text string, hint string"), names).collect()}
    assert got == {1: "Gold Ridge", 2: "Old Gold Ridge belt", 3: "Gold Ridge", 4: "ridge"}


def test_an_alias_of_two_areas_keeps_both(spark):
    aliases = spark.createDataFrame([("N0", "twin"), ("N1", "twin"), ("N2", "twin peaks")], "area_id string, alias string")
    texts = spark.createDataFrame([(1, "in twin"), (2, "in twin peaks")], "id int, text string")
    assert sorted((r.id, r.area_id) for r in E.find_areas(texts, aliases).collect()) == [(1, "N0"), (1, "N1"), (2, "N2")]


def test_frames_of_questions(spark):
    known = spark.createDataFrame([("N", "N"), ("N", "R"), ("R", "R"), ("M", "M")], "area string, ancestor string")
    hits = spark.createDataFrame([(1, "N", "n"), (1, "R", "r"), (2, "N", "n"), (2, "M", "m"), (3, "N", "x"), (3, "M", "x")], "id int, area_id string, alias string")
    asked = spark.createDataFrame([(1, "Встречается ли золото"), (2, "не обнаружен во всех"), (3, "гипотезы"), (4, None)], "id int, text string")
    got = {r.id: tuple(r)[1:] for r in Q.question_frames(asked, hits, known).collect()}
    assert got[1] == ("N", "gold", "EXISTS", "AFFIRM", "FACTUAL")
    assert got[2] == (None, None, "ALL", "NEGATE", "FACTUAL")
    assert got[3] == (None, None, "UNSPECIFIED", "AFFIRM", "RESEARCH_REVIEW")
    assert got[4][0] is None


def test_kinds_of_questions(spark):
    rows = ["Какая свита содержит руду?", "Где и как изучали руду?", "Какие породы вмещают руду?", "С чем связана аргиллизация?", "Расскажи о золоте"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = df.select(Q.is_narrow(F.col("t")).alias("n"), Q.about_links(F.col("t")).alias("l")).collect()
    assert [r.n for r in got] == [True, False, True, True, False]
    assert [r.l for r in got] == [False, False, False, True, False]


def test_kinds_of_odd_questions(spark):
    rows = ["В каком районе нашли золото?", "Какие минералы есть?", "Какая руда? Какая свита?", "Чем различаются свиты?", "Что контролирует оруденение?", "Где встречается уран?", "Где живут птицы и что едят?", "", None, "руда"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(Q.is_narrow(F.col("t")).alias("n"), Q.about_links(F.col("t")).alias("l")).collect()
    assert [r.n for r in got] == [True, False, False, False, False, True, False, False, False, False]
    assert [r.l for r in got] == [False, False, False, False, True, True, False, False, False, False]


def test_spellings_and_topics(spark):
    s = spark.createDataFrame([("a", 0, "золото"), ("a", 1, "gold"), ("b", 0, "donetsk basin"), ("b", 1, "donbass")], "group string, ord int, spelling string")
    q = spark.createDataFrame([(1, "Золото: Donetsk basin, север"), (2, "nothing")], "id int, text string")
    got = [(r.id, r.n, r.text) for r in Q.spelling_variants(q, s).orderBy("id", "n").collect()]
    assert got == [(1, 1, "gold donetsk basin север"), (1, 2, "золото donbass север")]
    assert Q.spelling_variants(q, s, 1).count() == 1
    glossary = {"рудный узел": "ore cluster", "золото": ["gold", "au"], "узел": "node"}
    assert Q.translate_topic("Золото рудный узел", glossary) == 'gold "ore cluster"'
    assert Q.translate_topic("золото анабар gis", glossary) == "gold gis"
    assert Q.translate_topic("золота анабар gis", glossary, key=lambda w: w[:5]) == "gold gis"
    assert Q.translate_topic("золото", glossary) is None and Q.translate_topic("gold ore", glossary) is None


def test_places_by_the_ratio_of_keys(spark):
    names = [("Bukantau",), ("Букантау",), ("Kuldur",), ("Lujing",), ("",), (None,)]
    df = spark.createDataFrame(names, "name string")
    got = [r.name for r in Q.resolve_place(df, ["Букантау"]).collect()]
    keys = {r[0]: r[1] for r in df.select("name", X.translit_key(F.col("name"))).collect()}
    assert sorted(got) == sorted(n for n, k in keys.items() if k and SequenceMatcher(None, keys["Букантау"], k).ratio() >= 0.85)
    assert set(got) == {"Bukantau", "Букантау"}
    near = spark.createDataFrame([("Lujing", 0.7), ("Kuldur", 0.7)], "name string, similarity double")
    assert [r.name for r in Q.resolve_place(near, ["Лудзин"]).collect()] == ["Lujing"]
    assert Q.resolve_place(df, []).count() == 0


def test_rounds_stop_without_news(spark):
    found = {"a": [1, 2], "b": [2, 3], "c": [3]}
    search = lambda qs: spark.createDataFrame([(i,) for q in qs for i in found.get(q, [])], "id int")
    taken, rounds = Q.gather_rounds(search, lambda hits: ["b", "a"], ["a"])
    assert sorted(r.id for r in taken.collect()) == [1, 2, 3] and rounds == 2
    asked = iter([["b"], ["c"], ["d"]])
    taken, rounds = Q.gather_rounds(search, lambda hits: next(asked), ["a"], most=5)
    assert sorted(r.id for r in taken.collect()) == [1, 2, 3] and rounds == 3


CHUNK = ["Gold occurs in quartz veins.", "The ore is old.", "Pyrite is with silver."]


def test_facts_are_checked(spark):
    rows = [
        (0, "1", "gold", "связан с", "quartz"),
        (1, "[1]", "Gold", "связан с", "quartz"),  # again
        (2, "2", "ore", "с", "silver"),  # with the next sentence
        (3, "2", "ore", "с", "quartz"),  # with the one before
        (4, "3", "gold", "с", "silver"),  # too far
        (5, "9", "gold", "с", "quartz"),
        (6, "1", "gold", "с", "gold"),
        (7, "1", "it", "с", "gold"),
        (8, "1", "gold", "", "quartz"),
        (9, None, "gold", "с", "quartz"),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "chunk_id int, ord int, n string, src string, relation string, dst string")
    chunks = spark.createDataFrame([(1, CHUNK), (2, [])], "chunk_id int, sents array<string>")
    kept, rejected = A.checked_facts(df, chunks)
    got = {r.ord: r.quote for r in kept.collect()}
    assert got == {0: CHUNK[0], 2: " ".join(CHUNK[1:]), 3: " ".join(CHUNK[:2])}
    assert {r.ord: r.reason for r in rejected.collect()} == {4: "not in quote", 5: "no sentence", 6: "self", 7: "pronoun", 8: "relation", 9: "no sentence"}
    kept, rejected = A.checked_facts(df, chunks, read=3, most=1)
    assert [r.ord for r in kept.collect()] == [0] and rejected.count() == 0


def test_a_pass_is_resumable(spark):
    chunks = spark.createDataFrame([(1, CHUNK), (2, CHUNK), (3, CHUNK)], "chunk_id int, sents array<string>")
    done = spark.createDataFrame([(2,)], "chunk_id int")
    facts = spark.createDataFrame([(7, 2, "a", "b", "c"), (8, 1, "old", "b", "c")], "id long, chunk_id int, src string, relation string, dst string")
    answer = lambda c: c.select("chunk_id", F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(n).alias("n"), F.lit("gold").alias("src"), F.lit("с").alias("relation"), F.lit("quartz").alias("dst")) for o, n in ((0, "1"), (1, "9"))])).alias("x")).select("chunk_id", "x.*")
    after, notes = A.extract_facts(chunks, done, facts, F.col("chunk_id") < 3, answer)
    assert sorted((r.chunk_id, r.src) for r in after.collect()) == [(1, "gold"), (2, "a")]
    assert [(r.chunk_id, r.n, r.reasons) for r in notes.collect()] == [(1, 1, "no sentence")]


def test_items_are_checked(spark):
    text = "Argillic alteration is wide. " + "x " * 300 + "Epidote  and chlorite occur."
    chunks = spark.createDataFrame([("d", 1, text), ("d", 2, "Pyrite near argillic alteration."), ("e", 1, "none")], "doc_id string, chunk_id int, text string")
    items = [(0, "Pyrite", "pyrite near", 2), (1, "Pyrite", "Pyrite near", 9), (2, "Pyrite", "Pyrite near", 1), (3, "chlorite", "Epidote and chlorite", 1), (4, "argillic alteration", "argillic alteration is", 1), (5, "gold", "Pyrite near", 2), (6, "", "Pyrite", 2)]
    df = spark.createDataFrame([("d", *x) for x in items], "doc_id string, ord int, what string, quote string, fragment int")
    got = {r.ord: r.chunk_id for r in A.checked_items(df, chunks, ["argillic alteration"]).collect()}
    assert got == {0: 2, 1: 2}
    assert {r.ord for r in A.checked_items(df, chunks, []).collect()} == {0, 1, 3, 4}


def test_json_rules(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "null"]}, "b": {"type": "string", "pattern": "^x"}, "c": {"type": "array"}}}
    rows = {'{"a": 1}': [], '{"a": null, "b": "xy", "c": []}': [], "{": ["$: json"], "[1]": ["$: type"], '{"b": "y"}': ["$.a: required", "$.b: pattern"], '{"a": 1.5, "c": 2}': ["$.a: type", "$.c: type"]}
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", A.json_problems(F.col("t"), schema).alias("p"))
    assert {r.t: r.p for r in df.collect()} == rows
    assert spark.createDataFrame([(None,)], "t string").select(A.json_problems(F.col("t"), schema)).first()[0] == ["$: json"]


def test_paragraphs_and_headings(spark):
    rows = [(0, "text", "It goes "), (1, "picture", "p"), (2, "text", " on and"), (3, "text", "on."), (4, "text", "small start"), (5, "heading", "h"), (6, "text", "after"), (7, "text", ""), (8, "text", "last")]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id int, ord int, label string, text string")
    got = [(r.ord, r.text, r.pieces) for r in A.join_paragraphs(df).orderBy("ord").collect()]
    assert got == [(0, "It goes on and on.", 3), (4, "small start", 1), (5, "h", 1), (6, "after", 1), (7, "", 1), (8, "last", 1)]
    pages = spark.createDataFrame([(1, "<h1 class=a>One &amp; <b>two</b></h1><H2>Three</H2 ><h5>no</h5><h3></h3>"), (2, None)], "page_id int, html string")
    assert [tuple(r) for r in A.page_sections(pages).orderBy("ord").collect()] == [(1, 0, 1, "One two"), (1, 1, 2, "Three")]


def test_names_of_persons_and_degrees(spark):
    df = spark.createDataFrame([("A. B. Smith",), ("Smith, A.",), ("very high",), ("Gold Ridge",)], "t string")
    assert [r[0] for r in df.select(X.name_problem(F.col("t"))).collect()] == ["person", "person", "degree", None]


def test_looping_and_uncited_answers():
    long = "This sentence of the answer is surely longer than sixty characters in all."
    assert X.is_looping(f"{long} Another one. {long} And now") and not X.is_looping(f"{long} Another one. And now")
    text = "# A\nThis sentence holds a claim that is without any source. It has one here [1].\n# B\nA claim without any source that is longer than forty."
    assert X.drop_uncited(text) == ("# A\nIt has one here [1].", ["This sentence holds a claim that is without any source.", "A claim without any source that is longer than forty."])


def test_node_scores_count_every_concept_once(spark):
    r = random.Random(5)
    node = lambda: r.choice(["hub", "hub", "a", "b", "c", f"n{r.randrange(40)}"])
    concepts = [(r.randrange(3) if r.random() < 0.95 else None, c, node()) for c in range(120) for _ in range(r.randrange(1, 4))] + [(0, 7, None), (1, None, "a"), (1, None, "b")]
    facts = [(k, r.randrange(60) if r.random() < 0.95 else None, node(), node() if r.random() < 0.95 else None) for k in range(150)]
    want = {}
    for _, chunk, src, dst in facts:
        for q, c, n in concepts:
            if n is not None and n in (src, dst):
                want.setdefault((q, chunk), set()).add(c)
    df = [spark.createDataFrame(concepts, "question int, concept int, node string"), spark.createDataFrame(facts, "id int, chunk_id int, src string, dst string")]
    got = {(x.question, x.chunk_id): x.score for x in Q.node_scores(*df).collect()}
    assert got == {k: float(len(v)) for k, v in want.items()}


def test_node_scores_make_no_row_for_each_concept_of_a_shared_node(spark):
    concepts = spark.range(3000).select((F.col("id") % 2).alias("question"), F.col("id").alias("concept"), F.explode(F.array(F.lit("hub"), F.concat(F.lit("own"), "id"))).alias("node"))
    facts = spark.range(3000).select("id", F.col("id").alias("chunk_id"), F.lit("hub").alias("src"), F.concat(F.lit("own"), "id").alias("dst"))
    df = Q.node_scores(concepts, facts)
    assert most_rows(df) <= 20_000
    assert {tuple(x) for x in df.select("question", "score").distinct().collect()} == {(0, 1500.0), (1, 1500.0)}
