"""Token counts, packing, decontamination and licences against plain versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from lithoframe.llm import decontaminate as D
from lithoframe.llm import licenses as L
from lithoframe.llm import packing as P
from lithoframe.llm import token_counts as T
from tests.llm.corpus import documents, edge_frames, frame, sentence

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def count(df):
    return T.count_tokens(df, BYTE, pattern=public_tokenizers.PATTERN, specials=("<|endoftext|>",))


def test_token_counts_equal_the_library(spark):
    rows = documents()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count(frame(spark, rows)).collect()}
    model = Tokenizer.from_file(BYTE)
    for i, t in rows:
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)


def test_whole_tokens_are_one_token_each():
    model, whole = Tokenizer.from_file(BYTE), T.prove_whole_tokens(BYTE)
    assert len(whole) > 30_000
    for s in random.Random(1).sample(sorted(whole), 300):
        assert len(model.encode(s, add_special_tokens=False).ids) == 1


@pytest.mark.parametrize("path", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_vocabularies_go_to_the_library(spark, path):
    rows = [(1, "plain words"), (2, "")]
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(frame(spark, rows), public_tokenizers.path(path)).collect()}
    assert got[1] > 0 and got[2] == 0


def test_word_encoder_equals_the_library():
    import pyarrow as pa

    texts = [t or "" for _, t in documents()] + ["a|b ab!c a'b 'S IT'S x--y <|STARTOFTEXT|> <|startoftext|>x ΣΑΣ İx ǅ", "...", "a.b. c,, d.,"]
    ids, bounds = P.WordEncoder(WORD)(pa.array(texts))
    model = Tokenizer.from_file(WORD)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == model.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_packing_places_every_piece_once(spark, capacity):
    rows = documents()
    got = P.pack_documents(frame(spark, rows), WORD, capacity=capacity, end_id=1, with_ids=True).toPandas()
    model = Tokenizer.from_file(WORD)
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        own = got[got.doc_id == i].sort_values("piece")
        assert [x for p in own.ids for x in p] == ids
        assert own.start.tolist() == list(range(0, len(ids), capacity))
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(own.ids, own.ids_crc32))
    for _, bin_ in got.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_.offset.tolist() == np.r_[0, np.cumsum(bin_.length)[:-1]].tolist()
        assert bin_.length.sum() <= capacity
    assert got.sequence_id.nunique() <= -(-int(got.length.sum()) // capacity) * 1.2 + 1


def test_plan_uses_two_documents_for_one_where_they_fit_better():
    bins = P.plan_bins({60: 1, 30: 1, 25: 1, 14: 1}, 100)
    # greedy: 60 + 30, then the 30 makes room for 25 + 14, which fill 99 of 100
    assert bins[0] == ({60: 1, 25: 1, 14: 1}, 1)
    assert sum(sum(k * n for n, k in b.items()) * t for b, t in bins) == 129


def test_plan_covers_the_histogram():
    r = random.Random(3)
    histogram = {r.randrange(1, 4097): r.randrange(1, 3000) for _ in range(500)}
    bins = P.plan_bins(histogram, 4096)
    used = {}
    for b, t in bins:
        assert sum(n * k for n, k in b.items()) <= 4096
        for n, k in b.items():
            used[n] = used.get(n, 0) + k * t
    assert used == histogram
    least = max(sum(n * c for n, c in histogram.items()) / 4096, sum(c for n, c in histogram.items() if n > 2048))
    assert sum(t for _, t in bins) <= least * 1.02 + 1


def fewest_bins(sizes, capacity):
    """By trying every place for every piece, largest first."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for at in range(len(bins)):
            if bins[at] + sizes[k] <= capacity and bins[at] not in bins[:at]:
                place(k + 1, [*bins[:at], bins[at] + sizes[k], *bins[at + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


def test_plan_is_within_one_bin_of_the_fewest_on_small_sets():
    r = random.Random(12)
    for _ in range(150):
        sizes = [r.randrange(1, 61) for _ in range(r.randrange(1, 11))]
        histogram = {n: sizes.count(n) for n in sizes}
        assert sum(t for _, t in P.plan_bins(histogram, 60)) <= fewest_bins(sizes, 60) + 1


def edit_distance_to_substring(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for k in range(len(p)):
            new.append(min(row[k] + (p[k] != c), row[k + 1] + 1, new[k] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_equals_dynamic_programming():
    r = random.Random(2)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randrange(1, 30)))
        t = "".join(r.choice("abc") for _ in range(r.randrange(0, 60)))
        assert D.myers(D.bit_masks(p), len(p), t)[0] == edit_distance_to_substring(p, t)


def test_leaks_equal_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(r.randrange(1, 40)))) for k in range(12)] + [(90, ""), (91, None)]
    rows = []
    for k in range(60):
        t = " ".join(word() for _ in range(80))
        if k % 2:
            x = list(items[r.randrange(12)][1])
            for _ in range(r.randrange(0, max(1, int(len(x) * 0.12)))):
                at = r.randrange(len(x))
                x[at : at + 1] = r.choice([[], ["z"], [x[at], "q"]])
            t = t[:100] + "".join(x).upper() + t[100:]
        rows.append((k, t))
    got = {(x.doc_id, x.item_id): x for x in D.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in rows:
        for k, p in items:
            if p:
                d = edit_distance_to_substring(D.normal_form(p), D.normal_form(t))
                assert ((i, k) in got) == (d <= D.budget(len(p), D.RATE, D.MIN_PIECE)), (i, k, d)
                if (i, k) in got:
                    x = got[i, k]
                    assert x.distance == d
                    assert edit_distance_to_substring(D.normal_form(p), D.normal_form(t[x.start : x.end])) == d
    clean = {x.doc_id for x in D.without_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in got}


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"question number {k} asks about the {k} small things in a box") for k in range(9)], "item_id long, text string")
    docs = frame(spark, [(1, "x question number 4 asks about the 4 small things in a box y"), (2, "none")])
    whole = sorted(map(tuple, D.find_leaks(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)
    assert sorted(map(tuple, D.find_leaks(docs, items).collect())) == whole and whole


def test_licenses(spark):
    mit = next(t for n, k, t in L.TEMPLATES if (n, k) == ("MIT", "text"))
    files = [
        (1, "a/LICENSE", "Copyright holders\n" + mit),
        (2, "a/b/c.py", "print"),
        (3, "a/b/d.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "z/e.py", "none"),
        (5, None, None),
        (6, "a/b/LICENSE.txt", "Licensed under CC BY 4.0."),
        (7, "a/q.py", ""),
        (8, "LICENSE", "All rights reserved."),
    ]
    got = {r.doc_id: (r.license, r.origin, r.inherited_from) for r in L.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "license_file", None), 2: ("CC-BY-4.0", "inherited", "a/b"), 3: ("Apache-2.0", "header", None), 4: ("Proprietary", "inherited", ""), 5: (None, None, None), 6: ("CC-BY-4.0", "license_file", None), 7: ("MIT", "inherited", "a"), 8: ("Proprietary", "license_file", None),
    }


def test_license_prefilter_changes_nothing(spark):
    templates = sorted(L.TEMPLATES)
    idf = {w: 1.0 + (len(w) % 5) for _, _, t in templates for w in L.terms(t)}
    m = L.Matcher(templates, idf, L.THRESHOLD, 6.0)
    r = random.Random(6)
    words = sorted(idf) + ["foo", "bar"]
    for _ in range(2000):
        s = " ".join(r.choice(words) for _ in range(r.randrange(1, 12)))
        if m.best(s)[0] >= L.THRESHOLD:
            assert next(m.automaton.iter(s.lower()), None) is not None


def test_edges(spark):
    from pyspark.sql import functions as F

    for name, df in edge_frames(spark).items():
        n = df.count()
        assert count(df).count() == n, name
        assert P.pack_documents(df, WORD).count() == n, name
        assert D.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0, name
        assert D.without_leaks(df, spark.createDataFrame([(1, "no such passage is in any text")], "item_id long, text string")).count() == n, name
        assert L.scan_licenses(df.withColumn("path", F.lit("d/f"))).count() == n, name


def test_licenses_equal_a_plain_tf_idf(spark):
    """Every line, paragraph and whole text against every template, with frequencies counted over the files."""
    mit = next(t for n, k, t in L.TEMPLATES if (n, k) == ("MIT", "text"))
    bsd = next(t for n, k, t in L.TEMPLATES if (n, k) == ("BSD-3-Clause", "text"))
    files = [
        (1, "a/LICENSE", "BSD License\n\nCopyright (c) 2020, The Authors\nAll rights reserved.\n\n" + bsd.replace(". ", ".\n")),
        (2, "a/src/x.py", "import os\nprint(os.name)"),
        (3, "b/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy this document."),
        (4, "b/deep/down/y.c", "int main() { return 0; }"),
        (5, "b/deep/z.c", "// GNU General Public License version 3, 29 June 2007\nint z;"),
        (6, "c/w.js", "/*\n" + mit + "\n*/\nAll rights reserved.\nlet w = 1"),
        (7, "c/v.js", "let v = 2"),
        (8, "v.js", "let u = 3"),
        (9, None, "Released under the MIT License."),
    ]
    n = len(files)
    count = lambda text: collections.Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower()))
    idf = lambda w: math.log((1 + n) / (1 + (sum(w in count(t) for _, _, t in files) if w in vocabulary else 0))) + 1
    vocabulary = {w for _, _, t in L.TEMPLATES for w in count(t)}

    def cosine(a, b):
        x, y = ({w: c * idf(w) for w, c in count(t).items()} for t in (a, b))
        return sum(v * y.get(w, 0) for w, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if x and y else 0

    def best(text):
        segments = [*text.split("\n"), *re.split(r"\n\s*\n", text), text]
        scores = [(cosine(s, t), k, name) for s in segments for name, k, t in L.TEMPLATES]
        found = [(["notice", "title", "text"].index(k), round(x, 6), name) for x, k, name in scores if x >= L.THRESHOLD]
        return max(found, default=None)

    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    for i, _, text in files:
        if (want := best(text)) is not None:
            assert (got[i].license, got[i].score) == (want[2], want[1]), i
    origins = {i: (r.license, r.origin, r.inherited_from) for i, r in got.items()}
    assert origins[1] == ("BSD-3-Clause", "license_file", None) and origins[2] == ("BSD-3-Clause", "inherited", "a")
    assert origins[3] == ("GPL-3.0", "license_file", None) and origins[4] == ("GPL-3.0", "inherited", "b")
    assert origins[5] == ("GPL-3.0", "header", None)
    assert origins[6] == ("MIT", "license_file", None) and origins[7] == ("MIT", "inherited", "c")
    assert origins[8] == (None, None, None) and origins[9] == ("MIT", "header", None)


def test_edited_items_are_found_within_the_budget(spark):
    """Items of 60 to 300 characters with up to 10 % of them changed, in single and in doubled spaces."""
    r = random.Random(8)
    items = [(k, sentence(r, r.randrange(12, 50))) for k in range(30)]
    docs = []
    for k, t in items:
        c = list(t)
        for at in r.sample(range(len(c)), D.budget(len(t), D.RATE, D.MIN_PIECE)):
            c[at] = "#"
        docs.append((k, sentence(r, 30) + " " + "".join(c).replace(" ", "  " if k % 2 else " ") + "\n\t" + sentence(r, 30)))
    docs.append((99, sentence(r, 400)))
    found = D.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} >= {(k, k) for k, _ in items} and all(x.doc_id == x.item_id for x in found)
    for x in found:
        text = docs[x.doc_id][1]
        assert not text[x.start].isspace() and not text[x.end - 1].isspace() and 0 <= x.distance - text[x.start : x.end].count("#") <= 2  # an edit at an end may lie outside
    kept = D.without_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [x.doc_id for x in kept] == [99]
