"""The pipeline's near-dedup at similarity 0.8 against brute force."""

import random
import re

import numpy as np
import pyarrow as pa

from lithoframe.llm import near_dedup as N
from tests.llm.corpus import documents, edge_frames, frame, sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(rows, least=0.8):
    """Smallest linked id of every id."""
    sets, of = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or both >= least * (len(a) + len(sets[j]) - both) > 0:
                p, q = find(i), find(j)
                of[max(p, q)] = min(p, q)
    return {rows[k][0]: rows[find(k)][0] for k in range(len(rows))}


def edited(n=24, seed=3):
    """Texts of 300 words, each with copies of 1 to 9 changed words and a chain of small edits."""
    r, texts = random.Random(seed), []
    for k in range(n):
        w = sentence(r, 300).split(" ")
        texts.append(" ".join(w))
        for c in (1, 3, 5, 6, 7, 9):
            x = list(w)
            for at in r.sample(range(300), c):
                x[at] = f"new{k}x{c}x{at}"
            texts.append(" ".join(x))
    w = sentence(r, 300).split(" ")
    for k in range(40):
        w = list(w)
        w[7 * k] = f"step{k}"
        texts.append(" ".join(w))
    r.shuffle(texts)
    return list(enumerate(texts))


def test_similar_groups_equal_brute_force(spark):
    for rows in (edited(), documents()):
        want = similar(rows)
        assert {r.doc_id: r.component_id for r in N.similar_groups(frame(spark, rows)).collect()} == want
        assert sorted(r.doc_id for r in N.keep_one_of_similar(frame(spark, rows)).collect()) == sorted(set(want.values()))


def test_the_pipeline_drops_edited_copies(spark):
    import corpus_pipeline as C

    rows = edited(6)
    kept = {r.doc_id for r in C.near_duplicates(spark, frame(spark, rows), "").collect()}
    assert kept == set(similar(rows).values())


def test_edges_of_similar_groups(spark):
    frames = edge_frames(spark)
    assert N.keep_one_of_similar(frames["empty"]).count() == 0
    assert sorted(str(r.doc_id) for r in N.keep_one_of_similar(frames["null_id"]).collect()) == ["1", "2", "None"]
    assert sorted(r.doc_id for r in N.keep_one_of_similar(frames["repeated"]).collect()) == [1, 2]
    assert N.keep_one_of_similar(frames["clash"]).columns == frames["clash"].columns


def test_a_large_group_of_near_copies_is_compared_in_blocks(spark, monkeypatch):
    """Copies of one text with so many edits that most are similar to few others."""
    r = random.Random(9)
    base = sentence(r, 200).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for at in r.sample(range(200), r.randrange(1, 7)):
            w[at] = f"new{i}x{at}"
        rows.append((i, " ".join(w)))
    want = similar(rows)
    for few, sets, hashes in ((2, 20, 2_000_000), (2, 512, 5_000)):
        monkeypatch.setattr(N, "FEW", few)
        monkeypatch.setattr(N, "BLOCK_SETS", sets)
        monkeypatch.setattr(N, "BLOCK_HASHES", hashes)
        assert {r.doc_id: r.component_id for r in N.similar_groups(frame(spark, rows)).collect()} == want


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    a, b = "one text of some words to keep", "quite another text with other words in it"
    rows = [(7, a), (7, b), (7, a), (8, "the third text here has its own words too"), (9, b), (3, a), (7, "")]
    for keep in (N.keep_one_of_similar, N.keep_one_of_each):
        kept = sorted(tuple(r) for r in keep(frame(spark, rows)).collect())
        assert kept == sorted([(3, a), (7, b), (7, ""), (8, rows[3][1])]), keep


def test_candidates_come_from_simhash_codes_by_segments(monkeypatch):
    """The codes of `similar_groups` are SimHash: close for similar sets, far for others, one segment at least in common."""
    r = np.random.default_rng(5)
    base = r.integers(-(2**63), 2**63, 400)
    sets = [base, np.r_[base[:356], r.integers(-(2**63), 2**63, 44)], r.integers(-(2**63), 2**63, 400), base[:3], base[:0], base[:4], base[:5]]
    lists = pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(range(7)), lists], ["id", "__key", "__set"])
    width, count, words = N.code_segments(200_000)

    def codes():
        return next(N._set_codes(iter([batch]), words, 0.8)).column("code").to_pylist()

    whole = codes()
    monkeypatch.setattr(N, "COUNTED", 33)
    assert codes() == whole
    # sets of three and none are similar to no other set
    assert [len(c) for c in whole] == [words, words, words, 0, 0, words, words]
    bits = [[c[k // (64 // width)] >> (k % (64 // width) * width) & ((1 << width) - 1) for k in range(count)] for c in (whole[0], whole[1])]
    assert any(a == b for a, b in zip(*bits))
    apart = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(whole[a], whole[b])) / (64 * words)
    assert apart(0, 1) < 0.22 and 0.4 < apart(0, 2) < 0.6


def coded(codes, parts=None):
    """A table of codes as `_close_across` gets it; keys from 0 on."""
    n = len(codes)
    rows = {"key": np.arange(n), "size": np.full(n, 100, np.int32), "part": np.arange(n) if parts is None else parts, "__b": np.zeros(n, np.int32)}
    return pa.table(rows | {"code": pa.array(codes.view(np.int64).tolist(), pa.list_(pa.int64()))})


def flipped(r, code, *bits):
    """``code`` with so many random bits of each word turned over."""
    out = code.copy()
    for k, n in enumerate(bits):
        for b in r.permutation(64)[:n].tolist():
            out[k] ^= np.uint64(1 << b)
    return out


def test_unlike_codes_that_agree_in_128_bits_by_chance_are_no_candidates():
    """40 of 128 bits let a share of 1e-5 of all unlike pairs through to the exact sets."""
    r = np.random.default_rng(7)
    base = r.integers(0, 2**63, 3, np.uint64)
    for bits, links in (((18, 18, 32), 0), ((12, 12, 12), 1), ((20, 19, 19), 1), ((20, 20, 19), 0)):
        codes = np.stack([base, flipped(r, base, *bits)])
        assert N._close_stars(coded(codes), 0.8).num_rows == links, bits


def test_a_block_sends_no_more_candidates_than_it_has_codes():
    """a group of near copies in different components goes on as its members, not as its pairs."""
    r = np.random.default_rng(8)
    base = r.integers(0, 2**63, 3, np.uint64)
    group = np.stack([flipped(r, base, 4, 4, 4) for _ in range(60)])
    codes = np.concatenate([group, r.integers(0, 2**63, (400, 3), np.uint64)])
    key = tuple(pa.scalar(x, pa.int64()) for x in (0, 0, 0, 0))
    out = N._close_across(key, coded(codes), 5, 0.8)
    assert out.num_rows == 60 and out["b"].null_count == 60 and sorted(out["a"].to_pylist()) == list(range(60))
    # two of the group are a single pair, and one component has none left
    assert [tuple(x[c] for c in "ab") for x in N._close_across(key, coded(codes[58:]), 5, 0.8).to_pylist()] == [(0, 1)]
    assert N._close_across(key, coded(group, np.zeros(60, np.int64)), 5, 0.8).num_rows == 0
