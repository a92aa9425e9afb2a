"""Classifier, language model, extraction and the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lithoframe.llm import html_text as H
from lithoframe.llm import language_model as M
from lithoframe.llm import quality as Q
from tests.llm.corpus import documents, edge_frames, frame, sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def labelled(n=400, seed=3):
    r = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        t = sentence(r, r.randrange(20, 120))
        bad = k % 3 == 0
        texts.append(" ".join(w + "%%%" for w in t.split(" ")) if bad else t)
        labels.append(0 if bad else 1)
    return list(enumerate(texts)), list(enumerate(labels))


def test_gradients_of_the_network():
    net = Q.ByteNet(seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = random.Random(1)
    texts = [sentence(r, 200).encode() for _ in range(5)]
    y, w = np.array([1, 0, 1, 0, 1.0]), np.full(5, 0.2)
    g, _ = net.gradients(texts, y, w)
    for k in g:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        e = 1e-5
        net.w[k][at] += e
        up = net.gradients(texts, y, w)[1]
        net.w[k][at] -= 2 * e
        down = net.gradients(texts, y, w)[1]
        net.w[k][at] += e
        assert abs(g[k][at] - (up - down) / (2 * e)) < 0.03 * abs(g[k][at]) + 1e-5, k


def test_scores_do_not_depend_on_company(monkeypatch):
    net = Q.ByteNet()
    texts = [t.encode() for t in ("a" * 511, "b" * 512, "c" * 513, "", "x y z " * 3000)]
    together = net.score(texts)
    alone = np.array([net.score([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-6)
    monkeypatch.setattr(Q, "_TILE", 2048)
    assert np.allclose(net.score(texts), alone, atol=1e-6)


def test_classifier_on_held_out_rows(spark):
    rows, labels = labelled()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.score_quality(docs, Q.train(docs, marks)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum(got[i].predicted == labels[i][1] for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    # held-out labels are not learned from
    other = spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in labels], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in Q.score_quality(docs, Q.train(docs, other)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_classifier_without_two_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.train(docs, none) == 0.5
    assert Q.train(docs, spark.createDataFrame([(2, 1), (1, 1), (5, None)], "doc_id long, quality int")) == 1.0
    assert [r.score for r in Q.score_quality(docs, 0.5).collect()] == [0.5, 0.5]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def test_base_scores_and_counts_equal_brute_force(spark, monkeypatch):
    rows = documents()
    monkeypatch.setattr(M, "SLICE_BYTES", 4000)
    monkeypatch.setattr(M, "TRAINER_BYTES", 2000)
    got = {r.doc_id: r for r in M.score_documents(frame(spark, rows)).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    c = collections.Counter(w for i, t in rows if i not in held for w in words_of(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w, r = words_of(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def vocabulary(head):
    return M.Vocabulary(1000, 300, head, {k: (10, 3) for k in range(M.TAIL)})


def test_probabilities_sum_to_one():
    head = [(k * 7919 + 1, k % M.TAIL, 1 + 1000 // (k + 1)) for k in range(500)]
    w = M.first_weights(vocabulary(head))
    r = np.random.default_rng(0)
    h = r.normal(0, 1, (1, M.HIDDEN)).astype(np.float32)
    every = np.arange(M.HEAD + M.TAIL)
    p = np.exp(M.token_scores(w, np.repeat(h, len(every), 0), every))
    assert abs(p.sum() - 1) < 1e-4


def test_gradients_of_the_language_model():
    w = M.first_weights(vocabulary([(k * 7919 + 1, k % M.TAIL, 1 + 1000 // (k + 1)) for k in range(500)]))
    w = {k: v.astype(np.float64) for k, v in w.items()}
    r = np.random.default_rng(1)
    tokens = r.choice(np.r_[:200, M.HEAD : M.HEAD + M.TAIL], (6, 4))
    fresh = r.random((6, 4)) < 0.2
    h, last = r.normal(0, 0.5, (4, M.HIDDEN)), r.integers(0, 100, 4)
    g, _, _ = M.window_gradients(w, h, last, tokens, fresh)
    for k in g:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        e = 1e-5
        w[k][at] += e
        up = M.window_gradients(w, h, last, tokens, fresh)[2]
        w[k][at] -= 2 * e
        down = M.window_gradients(w, h, last, tokens, fresh)[2]
        w[k][at] += e
        assert abs(g[k][at] - (up - down) / (2 * e)) < 0.02 * abs(g[k][at]) + 1e-6, k


def test_state_is_carried_over_windows():
    w = M.first_weights(vocabulary([(k + 1, k % M.TAIL, 5) for k in range(300)]))
    r = np.random.default_rng(2)
    sizes = [1, 3, 400, 37, 37, 2]
    starts = np.r_[0, np.cumsum(sizes)]
    tokens = r.integers(0, 300, starts[-1])
    got = M.document_scores(w, tokens, starts, rows=16)
    table = w["emb"] @ w["W"] + w["b"]
    for k in range(len(sizes)):
        h, total = np.zeros((M.HIDDEN, 1), np.float32), 0.0
        for t in tokens[starts[k] : starts[k + 1]]:
            total += M.token_scores(w, h.T, np.array([t]))[0]
            h = M.step(table[[t]].T, h, w["U"].T)
        assert abs(got[k] - total) < 1e-3 * abs(total)


def test_model_learns_order():
    tokens = np.tile([1, 2, 3, 4, 0], 30_000)
    starts = np.r_[0, np.arange(5, len(tokens) + 1, 5)]
    w = M.first_weights(vocabulary([(k + 1, 0, 100) for k in range(10)]))
    trained = M.fit(w, tokens, starts, 0.02)
    before, after = (M.document_scores(x, tokens[:50], starts[:11]).sum() for x in (w, trained))
    assert after > before * 0.3


def test_every_token_moves_the_weights():
    w = M.first_weights(vocabulary([(k + 1, 0, 100) for k in range(10)]))
    size = 10_007
    lanes = size // (8 * M.UPDATES)
    assert size % lanes
    ends = np.cumsum([len(x) for x in np.array_split(np.arange(size), lanes)])
    tokens = np.resize([1, 2, 3, 4, 0], size)
    starts = np.r_[np.arange(0, size, 5), size]
    trained = M.fit(w, tokens, starts, 0.02)
    for end in (ends[0], ends[size % lanes - 1], ends[size % lanes], size):
        other = tokens.copy()
        other[end - 1] = 5
        assert any((trained[k] != x).any() for k, x in M.fit(w, other, starts, 0.02).items())
    few = M.fit(w, tokens[:3], np.array([0, 3]), 0.02)
    assert any((few[k] != x).any() for k, x in w.items())


def test_counts_beyond_32_bits():
    blob = lambda kind, *x: np.array(x, kind).tobytes()
    sent = [(0, blob("<u8", 5, 9), blob("u1", 1, 2), blob("<u8", 3 * 2**30, 1)), (1, blob("<u8", 5), blob("u1", 1), blob("<u8", 3 * 2**30))]
    t = pa.table({"shard": pa.array([4, 4], pa.int32()), "slice": pa.array([x[0] for x in sent], pa.int32()), "hashes": [x[1] for x in sent], "tails": [x[2] for x in sent], "counts": [x[3] for x in sent]})
    got = M._add_up(t).to_pylist()
    back = {r["slice"]: np.frombuffer(r["counts"], "<u8").tolist() for r in got if r["kind"] == 0}
    assert back == {0: [6 * 2**30, 1], 1: [6 * 2**30]}
    assert {r["hash"]: r["n"] for r in got if r["kind"] == 2} == {5: 6 * 2**30, 9: 1}
    assert {r["tail"]: (r["n"], r["v"]) for r in got if r["kind"] == 1 and r["v"]} == {1: (6 * 2**30, 1), 2: (1, 1)}


def test_rows_without_an_id_spread_over_slices_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE_BYTES", 2000)
    rows = [(None, f"words of text {i} " * 5) for i in range(300)]
    docs, total = M._dealt(frame(spark, rows), "doc_id", F.col("text"))
    per_slice = [r["count"] for r in docs.groupBy("__slice").count().collect()]
    assert total == sum(len(t) for _, t in rows) and sum(per_slice) == 300 and max(per_slice) < 60
    rounds = {r.r: r["count"] for r in docs.groupBy(M._by_hash("round", M.ROUNDS).alias("r")).count().collect()}
    assert set(rounds) == set(range(M.ROUNDS)) and sum(rounds.values()) == 300 and min(rounds.values()) > 90


def test_model_beats_the_base_on_held_out_texts(spark):
    r = np.random.default_rng(5)
    follow = [r.permutation(40)[:3] for _ in range(40)]

    def text():
        at, out = 0, []
        for _ in range(60):
            at = follow[at][r.integers(3)]
            out.append(f"w{at}")
        return " ".join(out)

    got = M.score_documents(frame(spark, [(i, text()) for i in range(1500)])).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.3


def test_words_of_arrow_equal_the_pattern():
    texts = [t or "" for _, t in documents()] + ["\x0b\x0c A\tB\r\nC  ", "ÄÖ Ü x"]
    got = M.Words(pa.array(texts))
    for k, t in enumerate(texts):
        own = got.codes[got.starts[k] : got.starts[k + 1]]
        want = words_of(t)
        assert len(own) == len(want) and got.hash[own[-1]] == M.END
        assert len(set(own.tolist())) == len(set(want))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href=/>Home</a> Welcome</header><nav>menu <a>x</a></nav>
<div class="cookie-notice">We use cookies on this site to give you the best of it and for you.</div><div id=content><h1>Title here</h1>
<p>The quick brown fox is in the house of the man that was with the dog and for all of us it was a good day, as they said to him at the end of the day.</p><p>Short&nbsp;one.</p><p>AT&amp;T &lt;b&gt; caf&eacute;<b>s</b></p>
<div class=sidebar><p>Side text of the page and the rest</p></div></div><form>Name <input></form><section class="comments"><p>I think that the article is good and it was of use for me and the others in the end of it all.</p></section>
<footer>c 2020</footer><script>if(a<b){}</script></body></html>"""
BODY = "Title here The quick brown fox is in the house of the man that was with the dog and for all of us it was a good day, as they said to him at the end of the day. Short one. AT&T <b> cafés"


def test_extraction():
    assert H.main_text(PAGE) == BODY
    article = "<body><nav><ul><li><a>a</a></ul><div class='ad'>Buy the best of it now and be happy for all of your life with this.</div><article><h1>Kurz</h1><p><b>Ein Wort.<br><p>%%% ###</p><p>x &amp;amp; y</article><aside>side</aside>"
    assert H.main_text(article) == "Kurz Ein Wort. %%% ### x &amp; y"
    assert H.main_text(None) == H.main_text("") == H.main_text("<!-- only") == H.main_text("<script>var x = '</p>'") == ""
    assert H.main_text("<nav>menu<article><p>Inside a menu that nobody closed.</p></article>") == "Inside a menu that nobody closed."
    assert H.main_text("<article><p>a<div class=comments><p>no</p></div><p>b</article>") == "a b"


def test_extraction_of_tables(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in H.extract_text(df).collect())
    assert got == [(1, BODY, len(BODY)), (2, "", 0), (2, "", 0)]
    assert H.extract_text(df.limit(0)).count() == 0


def test_edges(spark):
    for name, df in edge_frames(spark).items():
        n = df.count()
        assert Q.score_quality(df, Q.ByteNet()).count() == n, name
        assert M.score_documents(df).count() == n, name


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    r = random.Random(8)
    rows, labels = labelled(150)
    passage = sentence(r, 60)
    item = sentence(r, 30)
    good = [sentence(r, 100) for _ in range(6)]
    planted = [good[0], good[0], good[1] + " " + passage + " " + good[1][::-1], good[2] + " " + passage + " " + good[2][::-1], good[3] + " " + item + " tail", good[4]]
    base = len(rows)
    rows += [(base + k, t) for k, t in enumerate(planted)] + [(base + 50, None)]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in C.STAGES[:-1]:
        df = C.materialize(stage(spark, df, str(tmp_path)), "t")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in df.collect()}
    first, second, third, fourth = kept.values()
    assert not any(i in first for i, y in labels if y == 0)
    assert all(i in first for i, y in labels if y == 1)
    assert base in second and base + 1 not in second
    assert passage in third[base + 2] and passage not in third[base + 3] and third[base + 3]
    assert base + 4 in third and base + 4 not in fourth and base + 5 in fourth
    packed = C.STAGES[-1][1](spark, df, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(fourth)
    assert C.run(spark, str(tmp_path)).count() == packed.count()


def test_second_pass_equals_a_plain_search():
    """The nearest decided neighbour, found by looking at every block."""

    def plain(labels, articles, weak):
        out = []
        for k, label in enumerate(labels):
            if label is None:
                known = [j for j in range(len(labels)) if labels[j] is not None and not (articles[j] and weak[j]) and (not articles[k] or articles[j] == articles[k])]
                # of the nearest on each side, the closer one, with weak ones two blocks further away
                sides = [max((j for j in known if j < k), default=None), min((j for j in known if j > k), default=None)]
                found = [(abs(j - k) + 2 * weak[j], not labels[j]) for j in sides if j is not None]
                label = not min(found)[1] if found else bool(articles[k])
            out.append(label)
        return out

    r = random.Random(4)
    for _ in range(400):
        n = r.randrange(1, 14)
        labels = [r.choice([None, None, True, False]) for _ in range(n)]
        articles = sorted(r.choice([0, 0, 1, 2]) for _ in range(n))
        weak = [r.random() < 0.3 and x is False for x in labels]
        assert H._by_neighbours(labels, articles, weak) == plain(labels, articles, weak)


def test_pages_without_an_article():
    prose = "It was in the old town that they had found the house of which she had spoken to him, and there were not many of them left by then, as it is with all that is old. "
    page = f"<body><p>Kurz</p><p>{prose}</p><p>So it was.</p><p>{prose * 2}</p><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><p>Zxq vbn wrt plk jhg fds mnb vcx zas qwe rty uio pas dfg hjk klm npq</p></body>"
    got = H.labelled_blocks(page)
    assert [(keep, by) for _, keep, by in got] == [(True, "neighbours"), (True, "stop words"), (True, "neighbours"), (True, "stop words"), (False, "links"), (False, "links"), (False, "stop words")]
    # a list of links in an article follows its neighbours; one without any words of its own goes
    article = f"<article><p>{prose}</p><p><a href=x>{prose}</a></p><p><a href=y>More</a></p></article>"
    assert [(keep, by) for _, keep, by in H.labelled_blocks(article)] == [(True, "stop words"), (True, "neighbours"), (False, "links")]


def test_extraction_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>x"), (3, None, "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "__html", "__c0", "n_chars", "__text", "__n")})
    got = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in H.extract_text(df).collect())
    assert [g[0] for g in got] == [1, 2, 3, 3] and got[0] == (1, "u", "", 0) and got[1] == (2, "u", "", 0) and got[2] == got[3]
    assert H.extract_text(df.where("false")).count() == 0
