"""Small documents for the tests: random words, copies, near copies, shared passages, odd texts."""

import random

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "pra", "stu") for b in ("n", "r", "st", "lo", "ring", "ve", "x")]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents(n=60, seed=5):
    r = random.Random(seed)
    passage = sentence(r, 60)
    texts = []
    for k in range(n):
        t = sentence(r, r.randrange(5, 200))
        if k % 7 == 3:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        if k % 9 == 4:
            t = texts[k - 2]
        if k % 11 == 5:
            w = texts[k - 1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        texts.append(t)
    texts += ["", None, "x", " \n\t ", "é" * 300, "日本語のテキスト " * 40, "a" * 500, texts[0], "Capital Words. And, punctuation! 12 <|endoftext|> '''s it's odd\x1cone"]
    return list(enumerate(texts))


#: Columns whose names operators use inside; they must not disturb.
CLASHING = ("__text", "__id", "fp", "score", "piece", "length", "license", "kept", "shard", "slice", "node", "component", "n_tokens", "distance", "start")


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASHING})
    return df


def edge_frames(spark):
    """Empty table; null id; repeated rows; clashing extra columns."""
    return {
        "empty": frame(spark, []),
        "null_id": frame(spark, [(None, "some words to read here"), (1, "some words to read here"), (2, None)]),
        "repeated": frame(spark, [(1, "one two three four five six")] * 3 + [(2, ""), (2, "")]),
        "clash": frame(spark, documents(8), clash=True),
    }
