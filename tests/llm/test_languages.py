"""Language mixtures against plain loops, planted mixtures, held-out accuracy and odd rows."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lithoframe.llm import languages as L
from tests.llm.corpus import CLASHING, edge_frames

DATA = "/root/testdata/sf0.001"
SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "lich", "ver"], "cc": ["ión", "ñar", "que", "los"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def corpus(n=120, seed=1):
    r = random.Random(seed)
    return [(k, text(r, lang, r.randrange(5, 80)), lang) for k in range(n) for lang in [r.choice(list(SYLLABLES))]]


def grams(t):
    """(bucket, count), one n-gram at a time."""
    b, out = L.lowered(t), Counter()
    for k in range(len(b) - L.ORDER + 1):
        g = b[k : k + L.ORDER]
        if b"  " not in g:
            out[int(L.bucket_ids(np.frombuffer(g, np.uint8))[0][0])] += 1
    return out


def em(counts, likelihood, held, share, steps):
    for _ in range(steps):
        new = [0.0] * len(share)
        for b, n in counts.items():
            part = [likelihood[b][x] * share[x] if x in held else 0.0 for x in range(len(share))]
            for x in held:
                new[x] += n * part[x] / sum(part)
        share = [x / sum(counts.values()) for x in new]
    fit = sum(n * math.log(sum(likelihood[b][x] * share[x] for x in held)) for b, n in counts.items())
    return share, fit


def plain(t, model):
    counts, k = grams(t), len(model.languages)
    held, share, best = set(range(k)), [1 / k] * k, None
    while held:
        share, fit = em(counts, model.likelihood, held, share, L.STEPS if len(held) > 1 else 0)
        worth = fit - len(held) * L.PENALTY * math.log(sum(counts.values()) + 1)
        if best is None or worth >= best[0]:
            best = worth, share
        least = min(held, key=lambda x: (share[x], x))
        held = held - {least}
        rest = sum(share[x] for x in held)
        share = [share[x] / rest if x in held and rest else 0.0 for x in range(k)]
    return best[1]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_counts_and_shares_equal_plain_loops(spark):
    rows = corpus()
    rows += [(900, "mixed CASE, 123 ka--to", None), (901, "ver", "aa")]
    model = L.train(frame(spark, rows))
    want = {x: Counter() for x in SYLLABLES}
    for k, t, lang in rows:
        if lang and zlib.crc32(str(k).encode()) % 4 != 2:
            want[lang] += grams(t)
    assert model.languages == sorted(want)
    for k, lang in enumerate(model.languages):
        n = np.array([want[lang][b] + L.SMOOTHING for b in range(L.BUCKETS)])
        assert np.allclose(model.likelihood[:, k], n / n.sum())
    r = random.Random(8)
    texts = [t for _, t, _ in rows[:25]] + [text(r, "aa", 60) + " " + text(r, "cc", 30), "a", text(r, "aa", 4) + text(r, "bb", 4)]
    got = model.shares(texts)
    for t, share in zip(texts, got):
        assert np.allclose(share, plain(t, model), atol=1e-9), t


def test_planted_mixtures_are_found(spark):
    model = L.train(frame(spark, corpus()))
    r = random.Random(5)
    docs = [(1, text(r, "aa", 300) + " " + text(r, "bb", 100)), (2, text(r, "cc", 200)), (3, text(r, "bb", 100) + " " + text(r, "cc", 90) + " " + text(r, "aa", 80))]
    got = {x.doc_id: x for x in L.identify(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert [m.lang for m in got[1].languages] == ["aa", "bb"] and got[1].lang_pred == "aa"
    assert [m.lang for m in got[2].languages] == ["cc"] and got[2].score == 1
    assert {m.lang for m in got[3].languages} == {"aa", "bb", "cc"}
    assert all(abs(sum(m.share for m in x.languages) - 1) < 1e-9 for x in got.values())


def test_long_texts_are_counted_whole(monkeypatch):
    r = random.Random(6)
    t = text(r, "cc", 3000) + " " + text(r, "bb", 10)
    whole = L.counted([t, "ka to"])
    monkeypatch.setattr(L, "_TILE", 1000)
    for a, b in zip(whole, L.counted([t, "ka to"])):
        assert (a == b).all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy_and_independence_of_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    right = L.op12_language_mixtures(spark, DATA).where("held_out").join(docs, "doc_id").selectExpr("avg(CAST(lang = lang_pred AS INT))", "min(score)", "max(score)").first()
    assert right[0] >= 0.97 and 0 <= right[1] and right[2] <= 1
    model = L.train(docs)
    blind = L.identify(docs.selectExpr("doc_id + 5 AS doc_id", "text", "'de' AS lang"), model).selectExpr("doc_id - 5", "lang_pred", "score").collect()
    assert sorted(map(tuple, blind)) == sorted(map(tuple, L.identify(docs, model).select("doc_id", "lang_pred", "score").collect()))


def test_edges(spark):
    model = L.train(frame(spark, corpus()))
    odd = [(1, None), (2, ""), (3, "12 3!"), (4, "日本語"), (None, "ka to mi"), (5, "ka\x00to"), (5, "ka\x00to"), (6, "Ω")]
    got = {(r.doc_id, r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert {(1, "und", 1.0), (2, "und", 1.0), (3, "und", 1.0)} <= got and all(r[1] != "und" for r in got if r[0] in (4, None, 5, 6))
    assert L.train(frame(spark, [])) is None and L.train(frame(spark, [(1, "x", None), (None, "y", "aa")])) is None
    assert {r.lang_pred for r in L.identify(spark.createDataFrame(odd, "doc_id long, text string"), None).collect()} == {"und"}
    for name, df in edge_frames(spark).items():
        assert L.identify(df, model).count() == df.count(), name
    clash = edge_frames(spark)["clash"]
    assert set(CLASHING) <= set(clash.columns) and L.identify(clash, model).columns == ["doc_id", "lang_pred", "score", "languages"]
