"""Almost equal names against all pairs, and the stored word index against one that is built anew."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lithoframe.operators import fuzzy_names as N
from lithoframe.operators import words as W
from lithoframe.operators.stored_words import WordIndex, slot
from lithoframe.plans.scratch import materialize, new_path


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def spelled(r, length):
    return "".join(r.choice("aaabelnorst") for _ in range(length))


def changed(r, name, times):
    for _ in range(times):
        k = r.randrange(len(name) + 1)
        name = r.choice([name[:k] + r.choice("abelnoz") + name[k:], name[:k] + name[k + 1 :], name[:k] + r.choice("xz") + name[k + 1 :]])
    return name


def keys(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "key string")


@pytest.mark.parametrize("least", [0.7, 0.85, 0.9, 1.0])
def test_alike_keys_are_those_of_all_pairs(spark, least, monkeypatch):
    monkeypatch.setattr(N, "CROWD", 5)
    r = random.Random(int(least * 100))
    left = [spelled(r, r.choice([1, 2, 3, 5, 8, 14, 20, 31, 33, 40, 70, 150])) for _ in range(90)]
    right = [changed(r, r.choice(left), r.choice([0, 1, 2, 3, 6])) for _ in range(250)] + left[:10] + ["same run"] * 30 + [f"same run {k}" for k in range(20)]
    left += ["same run", "", None, "same run"]
    right += ["", None, "гора", "\U0001f5fbхребет"]
    want = {(a, b): ratio(a, b) for a in set(left) - {"", None} for b in set(right) - {"", None} if ratio(a, b) >= least}
    got = N.alike_keys(keys(spark, left), keys(spark, right), least).collect()
    assert len(got) == len({(x.a, x.b) for x in got})
    assert {(x.a, x.b): x.ratio for x in got} == want
    assert len(want) > 40 and any(len(a) > 32 and a != b for a, b in want) == (least < 1)


def test_few_pairs_are_verified(spark):
    r = random.Random(4)
    syllables = ["ber", "ley", "rez", "vic", "ham", "tan", "kos", "son", "dal", "or", "ni", "gu"]
    name = lambda: "".join(r.choice(syllables) for _ in range(6))
    left, right = [name() for _ in range(150)], [name() for _ in range(1500)]
    left += [changed(r, x, 2) for x in right[:50]]
    met = {(x.a, x.b) for x in N.candidates(keys(spark, left), keys(spark, right), 0.85).collect()}
    want = {(a, b) for a in left for b in right if ratio(a, b) >= 0.85}
    assert want <= met and len(met) < 0.02 * len(left) * len(right)


def test_tables_without_rows_and_bad_bounds(spark):
    none, one = keys(spark, []), keys(spark, ["ab", None])
    assert N.alike_keys(none, one).count() == N.alike_keys(one, none).count() == 0
    with pytest.raises(ValueError):
        N.alike_keys(one, one, 0.5)


def test_places_by_spelling_and_by_similarity(spark):
    names = spark.createDataFrame([("Bukantau",), ("Bukantau",), ("Bukan tau",), ("Bukantaus",), ("Lujing",), ("Far",), (None,), ("",)], "name string")
    asked = spark.createDataFrame([(1, "Букантау"), (1, "Bukantau"), (2, "Лудзин"), (3, None), (4, "nowhere at all")], "place int, spelling string")
    got = [(x.place, x.name, x.score, x.pos) for x in N.resolve_places(names, asked, most=2).collect()]
    assert sorted(got) == [(1, "Bukan tau", 1.0, 1), (1, "Bukantau", 1.0, 2)]
    similar = spark.createDataFrame([(2, "Lujing", 0.7), (2, "Lujing", 0.65), (2, "Far", 0.9), (1, "Bukantaus", 0.9), (4, "Lujing", 0.99)], "place int, name string, similarity double")
    got = {(x.place, x.name): x.pos for x in N.resolve_places(names, asked, similar=similar, most=2).collect()}
    assert got == {(1, "Bukantaus"): 1, (1, "Bukan tau"): 2, (2, "Lujing"): 1}


WORDS = "vein gold ore dyke fault schist basalt ring".split()


def random_texts(r, ids):
    return {i: " ".join(r.choice(WORDS) for _ in range(r.choice([0, 1, 5, 30]))) for i in ids}


QUERIES = ["gold vein", '"gold vein"', "ore -dyke", '"ring ore" -gold', "nothing", ""]


def same_as_anew(spark, index, now):
    fresh = W.word_index(spark.createDataFrame(list(now.items()) or [(0, "")], "id long, text string"))
    fresh = materialize(fresh, "fresh")
    for k, text in enumerate(QUERIES):
        q = W.parse(text, any_word=k % 2 == 0)
        assert [tuple(x) for x in index.search(q, 7).collect()] == [tuple(x) for x in W.search_index(fresh, q, 7).collect()], text


def test_batches_changes_and_removals_equal_an_index_built_anew(spark):
    r, path = random.Random(8), new_path(spark, "index-test")
    index, now = WordIndex(spark, path, slots=4), {}
    assert index.top(["gold"], 3).count() == 0 and index.segments() == []
    frame = lambda d: spark.createDataFrame([(*x, "clash") for x in d.items()], "id long, text string, word string")
    for ids in (range(40), range(30, 60), range(5)):
        batch = random_texts(r, ids)
        new = sum(now.get(i) != t for i, t in batch.items())
        now |= batch
        assert index.add(frame(batch)) == new
    same_as_anew(spark, index, now)
    assert index.add(frame(now)) == 0 and len(index.segments()) == 3
    gone = [3, 4, 50, 999]
    assert index.remove(spark.createDataFrame([(i,) for i in gone + gone], "id long")) == 3
    now = {i: t for i, t in now.items() if i not in gone}
    again = WordIndex(spark, path, slots=4)
    again.merge()
    assert len(again.segments()) == 1 and again._stale().count() == 0
    same_as_anew(spark, again, now)
    back = {3: "gold vein gold", 4: None}
    assert again.add(frame(back)) == 2
    same_as_anew(spark, again, now | {3: "gold vein gold", 4: ""})
    assert again.add(spark.createDataFrame([(None, "gold"), (7, "ore"), (7, "ore")], "id long, text string")) == (now[7] != "ore")


def test_a_batch_that_fails_half_way_changes_nothing(spark, monkeypatch):
    index = WordIndex(spark, new_path(spark, "index-test"), "string", slots=4)
    rows = lambda *x: spark.createDataFrame(list(x), "id string, text string")
    index.add(rows(("a", "gold vein")))
    held = WordIndex._commit
    monkeypatch.setattr(WordIndex, "_commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(rows(("a", "ore"), ("b", "gold")))
    monkeypatch.setattr(WordIndex, "_commit", held)
    assert [x.id for x in index.top(["gold"], 5).collect()] == ["a"]
    assert index.add(rows(("a", "ore"), ("b", "gold"))) == 2
    assert [x.id for x in index.top(["gold"], 5).collect()] == ["b"]


def test_only_the_words_folders_and_columns_are_read(spark):
    index = WordIndex(spark, new_path(spark, "index-test"))
    index.add(spark.createDataFrame([(i, " ".join(WORDS)) for i in range(20)], "id long, text string"))
    found = index.top(["gold", "ore"], 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "slot#" in x and "FileScan" in x)
    assert "PartitionFilters: [" in scan and "In(word, [gold,ore])" in scan and "positions" not in scan
    read = {f.split("slot=")[1].split("/")[0] for f in index.postings(["gold", "ore"]).inputFiles() if "slot=" in f}
    slots = {str(x[0]) for x in spark.createDataFrame([("gold",), ("ore",)], "w string").select(slot(F.col("w"), 32)).collect()}
    assert slots <= read
