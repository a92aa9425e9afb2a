"""Dictionary entries in texts against a plain search."""

import contextlib
import io
import random
import re

import pytest

from lithoframe.operators import dictionary as D
from lithoframe.operators import evidence as E
from lithoframe.operators import linking as L


def plain(texts, entries, longest, widest):
    out = []
    for i, text in texts:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        hits = [(at, n, e) for at in range(len(words)) for n in range(1, longest + 1) if at + n <= len(words) for e in entries if e[0] == " ".join(words[at : at + n])]
        for at, n, e in hits:
            inside = any((a <= at and a + m >= at + n) and (a, m) != (at, n) for a, m, _ in hits)
            if not (widest and inside):
                out.append((i, at, n, *e))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "c", "dd", "É", "7"])
    texts = [(k, r.choice([" ", ", ", "-", "  "]).join(word() for _ in range(r.randrange(12)))) for k in range(150)]
    texts += [(150, None), (151, ""), (152, "?!"), (3, "a b a b a"), (153, "a b " * 30_000 + "dd")]
    keys = {" ".join(word().lower() for _ in range(r.randrange(1, 5))) for _ in range(25)} | {"", " a", "a  b", "a-b", "a b a b a", "a b a b a b"}
    return texts, [(k, f"{k}/{j}") for k in sorted(keys) for j in range(1 + (len(k) == 3))] + [(None, "null")]


@pytest.mark.parametrize("widest", [True, False])
@pytest.mark.parametrize("block, part", [(1 << 21, 1 << 24), (300, 1000)])
def test_equal_to_a_plain_search(spark, monkeypatch, widest, block, part):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "PART", max(part, 40_000))
    texts, entries = corpus(5)
    found = D.find_entries(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(entries, "key string, term string"), widest=widest)
    assert found.columns == ["id", "at", "n", "key", "term"]
    got = sorted(map(tuple, found.collect()))
    small = [t for t in texts if t[0] != 153]
    assert [g for g in got if g[0] != 153] == plain(small, entries, 5, widest)
    own = [g for g in got if g[0] == 153]
    last = max(g[1] + g[2] for g in own)
    assert last >= 60_000 and len({(g[1], g[2], g[4]) for g in own}) == len(own)


def test_empty_tables(spark, monkeypatch):
    texts, entries = spark.createDataFrame([(1, "a b")], "id long, text string"), spark.createDataFrame([("a", "x")], "key string, term string")
    assert D.find_entries(texts.limit(0), entries).collect() == []
    assert D.find_entries(texts, entries.limit(0)).collect() == []
    monkeypatch.setattr(D, "BLOCK", 1)
    assert D.find_entries(texts.limit(0), entries).collect() == []
    assert [tuple(r) for r in D.find_entries(texts, entries).collect()] == [(1, 0, 1, "a", "x")]


def test_a_hundred_thousand_entries(spark):
    entries = spark.range(100_000).selectExpr("concat('name ', id) key", "id entry")
    texts = spark.range(2_000).selectExpr("id", "concat('Of name ', id * 50, ', and NAME ', id * 50 + 1, '; name x') text")
    got = D.find_entries(texts, entries)
    assert got.count() == 4_000
    assert got.where("entry <> id * 50 + at div 3").count() == 0


def printed(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_no_text_is_broadcast_and_no_run_of_words_made(spark):
    texts = spark.createDataFrame([(1, "north delta")], "id long, text string")
    linked = L.link_terms(texts, spark.createDataFrame([("delta", "d")], "key string, term string"))
    areas = E.find_areas(texts, spark.createDataFrame([("A", "Delta")], "area_id string, alias string"))
    for plan in map(printed, (linked, areas)):
        assert "MapInArrow" in plan and "Broadcast" not in plan and "Generate" not in plan
