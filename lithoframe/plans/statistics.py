"""Queries of the statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.operators import statistics as T
from lithoframe.plans.catalog import query
from lithoframe.plans.views import CHUNKS, FACTS, chunks, facts, table

_Z = T.Z95
_W = "(({k}::DOUBLE / {n} + {z} * {z} / (2 * {n}) {s} {z} * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + {z} * {z} / (4.0::DOUBLE * {n} * {n}))) / (1 + {z} * {z} / {n}))"


def _wilson_sql(k, n, sign):
    return _W.format(k=k, n=n, z=f"{_Z!r}::DOUBLE", s=sign)


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


_COUNTS = "c AS (SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang)"


@query(f"WITH {_COUNTS} SELECT lang, k, n, round({_wilson_sql('k', 'n', '-')}, 6) AS lo, round({_wilson_sql('k', 'n', '+')}, 6) AS hi FROM c")
def wilson_interval(spark, sf_dir):
    c = _labelled(spark, sf_dir).groupBy("lang").agg(F.sum("quality").cast("long").alias("k"), F.count("*").alias("n"))
    lo, hi = T.wilson(F.col("k"), F.col("n"))
    return c.select("lang", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


_L1, _U1, _L2, _U2 = (_wilson_sql(k, n, s) for k, n, s in (("k1", "n1", "-"), ("k1", "n1", "+"), ("k2", "n2", "-"), ("k2", "n2", "+")))


@query(
    f"""WITH {_COUNTS}, p AS (SELECT a.lang AS lang, a.k AS k1, a.n AS n1, b.k AS k2, b.n AS n2 FROM c a, c b WHERE b.lang = 'en' AND a.lang <> 'en')
SELECT lang, round(k1::DOUBLE / n1 - k2::DOUBLE / n2 - sqrt(pow(k1::DOUBLE / n1 - {_L1}, 2) + pow({_U2} - k2::DOUBLE / n2, 2)), 6) AS lo, round(k1::DOUBLE / n1 - k2::DOUBLE / n2 + sqrt(pow({_U1} - k1::DOUBLE / n1, 2) + pow(k2::DOUBLE / n2 - {_L2}, 2)), 6) AS hi FROM p"""
)
def newcombe_interval(spark, sf_dir):
    c = _labelled(spark, sf_dir).groupBy("lang").agg(F.sum("quality").cast("long").alias("k1"), F.count("*").alias("n1"))
    en = c.where("lang = 'en'").select(F.col("k1").alias("k2"), F.col("n1").alias("n2"))
    lo, hi = T.newcombe(*[F.col(x) for x in ("k1", "n1", "k2", "n2")])
    return c.where("lang <> 'en'").join(F.broadcast(en), F.lit(True)).select("lang", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query(
    """WITH RECURSIVE p AS (SELECT 0 AS n, 0 AS i, 1.0::DOUBLE AS c UNION ALL SELECT CASE WHEN i < n THEN n ELSE n + 1 END, CASE WHEN i < n THEN i + 1 ELSE 0 END, CASE WHEN i < n THEN c * (n - i) / (i + 1) ELSE 1.0 END FROM p WHERE n < 21),
d AS (SELECT source, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT d.source, d.k, d.n, round(CASE WHEN d.n = 0 THEN 1 ELSE least(1.0, 2 * (SELECT sum(p.c) FROM p WHERE p.n = d.n AND p.i <= least(d.k, d.n - d.k)) / pow(2.0, d.n)) END, 9) AS p FROM d WHERE d.n <= 20"""
)
def binomial_test(spark, sf_dir):
    d = _labelled(spark, sf_dir).groupBy("source").agg(F.sum("toxic").cast("long").alias("k"), F.count("*").alias("n")).where("n <= 20")
    return d.select("source", "k", "n", F.round(T.binomial_two_sided(F.col("k"), F.col("n")), 9).alias("p"))


@query(
    """WITH x AS (SELECT lang, n_chars AS s, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), a AS (SELECT lang, s, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM x GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a)
SELECT lang, round(sum(p * (below + n / 2.0::DOUBLE)) / nullif(sum(p) * sum(n), 0), 6) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM b GROUP BY lang"""
)
def roc_auc(spark, sf_dir):
    return T.auc(_labelled(spark, sf_dir).withColumn("pos", F.col("quality") == 1), "n_chars", "pos", ["lang"])


_PRED = "x AS (SELECT doc_id, source AS question, CASE WHEN quality = 0 THEN 'UNRESOLVED' WHEN toxic = 1 THEN 'OUT_OF_SCOPE' ELSE 'DIRECT' END AS gold, CASE WHEN n_chars > 3000 THEN 'ANALOG' WHEN n_chars > 600 THEN 'DIRECT' ELSE 'UNRESOLVED' END AS predicted FROM documents JOIN labels USING (doc_id))"


def _predictions(spark, sf_dir):
    gold = F.when(F.col("quality") == 0, "UNRESOLVED").when(F.col("toxic") == 1, "OUT_OF_SCOPE").otherwise("DIRECT")
    predicted = F.when(F.col("n_chars") > 3000, "ANALOG").when(F.col("n_chars") > 600, "DIRECT").otherwise("UNRESOLVED")
    return _labelled(spark, sf_dir).select("doc_id", F.col("source").alias("question"), gold.alias("gold"), predicted.alias("predicted"))


@query(f"""WITH {_PRED} SELECT gold, count(*) FILTER (WHERE predicted = 'DIRECT') AS "DIRECT", count(*) FILTER (WHERE predicted = 'ANALOG') AS "ANALOG", count(*) FILTER (WHERE predicted = 'UNRESOLVED') AS "UNRESOLVED" FROM x GROUP BY gold""")
def confusion_matrix(spark, sf_dir):
    return T.confusion(_predictions(spark, sf_dir), "gold", "predicted", ["DIRECT", "ANALOG", "UNRESOLVED"])


_DIV = "CASE WHEN {b} > 0 THEN round({a} / {b}, 6) END"
_AWAY, _D = "gold IN ('ANALOG', 'OUT_OF_SCOPE')", "predicted = 'DIRECT'"


def _ratio(a, b):
    return _DIV.format(a=f"count(*) FILTER (WHERE {a})", b=f"count(*) FILTER (WHERE {b})")


@query(
    f"""WITH {_PRED} SELECT count(*) AS pairs, {_ratio(f"{_AWAY} AND {_D}", _AWAY)} AS false_target, round(count(DISTINCT CASE WHEN gold = 'DIRECT' AND {_D} THEN question END) / count(DISTINCT CASE WHEN gold = 'DIRECT' THEN question END), 6) AS coverage,
{_ratio(f"{_D} AND gold <> 'DIRECT'", _D)} AS risk, {_ratio(f"gold = 'DIRECT' AND {_D}", "gold = 'DIRECT'")} AS recall, {_ratio("predicted = 'UNRESOLVED'", "TRUE")} AS unresolved, {_ratio("gold = predicted", "TRUE")} AS accuracy FROM x"""
)
def applicability_metrics(spark, sf_dir):
    return T.decision_metrics(_predictions(spark, sf_dir))


_RUN = "r AS (SELECT o_custkey % 100 AS question, o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders), w AS (SELECT c_custkey % 100 AS question, c_custkey AS doc FROM customer WHERE c_mktsegment = 'BUILDING')"


def _runs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy(F.col("o_custkey") % 100).orderBy(F.desc("o_totalprice"), "o_orderkey")
    runs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("question"), F.col("o_custkey").alias("doc"), F.row_number().over(w).alias("pos"))
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") % 100).alias("question"), F.col("c_custkey").alias("doc"))
    return runs, wanted


@query(
    f"""WITH {_RUN}, f AS (SELECT question, doc, min(pos) AS pos FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY pos) AS rank FROM f),
h AS (SELECT k.question, min(rank) AS rank FROM k JOIN w ON w.question = k.question AND w.doc = k.doc WHERE rank <= 10 GROUP BY k.question)
SELECT q.question, CAST(coalesce(h.rank <= 5, FALSE) AS INTEGER) AS top, CAST(coalesce(h.rank = 1, FALSE) AS INTEGER) AS first, round(coalesce(1.0::DOUBLE / h.rank, 0), 6) AS reciprocal FROM (SELECT DISTINCT question FROM w) q LEFT JOIN h ON h.question = q.question"""
)
def retrieval_metrics(spark, sf_dir):
    return T.retrieval_metrics(*_runs(spark, sf_dir))


@query(
    f"""WITH {FACTS}, g AS (SELECT votes, dst LIKE 'P1%' AS gold FROM facts) SELECT k, count(*) FILTER (WHERE coalesce(votes >= k, FALSE) AND gold) AS tp, count(*) FILTER (WHERE coalesce(votes >= k, FALSE) AND NOT gold) AS fp, count(*) FILTER (WHERE NOT coalesce(votes >= k, FALSE) AND gold) AS fn, count(*) FILTER (WHERE NOT coalesce(votes >= k, FALSE) AND NOT gold) AS tn,
round(count(*) FILTER (WHERE coalesce(votes >= k, FALSE) AND gold) / count(*) FILTER (WHERE coalesce(votes >= k, FALSE)), 6) AS precision, round(count(*) FILTER (WHERE coalesce(votes >= k, FALSE) AND gold) / count(*) FILTER (WHERE gold), 6) AS recall FROM g, (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY k"""
)
def vote_threshold_support(spark, sf_dir):
    return T.threshold_support(facts(spark, sf_dir).withColumn("gold", F.col("dst").like("P1%")), "votes", "gold", [1, 2, 3, 4])


@query("WITH s AS (SELECT lang, avg(quality) AS m, count(*) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang), p AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT round(sum(m * n) / sum(n), 6) AS share, CAST(sum(n) AS BIGINT) AS population, CAST(sum(k) AS BIGINT) AS sampled FROM s JOIN p USING (lang)")
def stratified_estimate(spark, sf_dir):
    return T.stratified_share(_labelled(spark, sf_dir), table(spark, sf_dir, "documents"), "lang", "quality")


@query()
def cluster_bootstrap(spark, sf_dir):
    """Mean quality with an interval, whole sources resampled."""
    return T.bootstrap_mean(_labelled(spark, sf_dir), "quality", "source")


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('split|' || doc_id), 1, 8) AS BIGINT) % 100 < 30 THEN 'DEV' ELSE 'TEST' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.hash_split(F.col("doc_id")).alias("split"))


@query(
    f"""WITH {_RUN}, two AS (SELECT 'price' AS run, question, doc, pos FROM r UNION ALL SELECT 'even', question, doc, pos FROM r WHERE doc % 2 = 0), j AS (SELECT question, doc, doc % 3 = 0 AS useful FROM w), t AS (SELECT two.run, j.useful FROM two LEFT JOIN j ON j.question = two.question AND j.doc = two.doc WHERE two.pos <= 5)
SELECT run, count(useful) AS judged, count(*) FILTER (WHERE useful) AS found, round(count(*) FILTER (WHERE useful) / count(useful), 6) AS precision, round(count(*) FILTER (WHERE useful) / (SELECT count(*) FROM j WHERE useful), 6) AS pooled_recall FROM t GROUP BY run"""
)
def pooled_precision(spark, sf_dir):
    runs, wanted = _runs(spark, sf_dir)
    two = runs.withColumn("run", F.lit("price")).unionByName(runs.where("doc % 2 = 0").withColumn("run", F.lit("even")))
    return T.pooled_precision(two, wanted.withColumn("useful", F.col("doc") % 3 == 0))


@query(
    """WITH a AS (SELECT source, round(avg(quality), 4) AS now FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 0 AND source <> 'src3' GROUP BY source), b AS (SELECT source, round(avg(quality), 4) AS before FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 1 OR source IN ('src3', 'src4') GROUP BY source)
SELECT coalesce(a.source, b.source) AS source, now, before, CASE WHEN before IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN now > before THEN 'better' WHEN now < before THEN 'worse' ELSE 'same' END AS change FROM a FULL OUTER JOIN b ON a.source = b.source"""
)
def run_delta(spark, sf_dir):
    x = _labelled(spark, sf_dir)
    mean = lambda d: d.groupBy("source").agg(F.round(F.avg("quality"), 4).alias("v"))
    return T.run_delta(mean(x.where("doc_id % 2 = 0 AND source <> 'src3'")), mean(x.where("doc_id % 2 = 1 OR source IN ('src3', 'src4')")), "source", "v")


@query("SELECT CASE WHEN quality = 0 AND toxic = 0 THEN 'fixed' WHEN quality = 1 AND toxic = 1 THEN 'broken' WHEN quality = 1 THEN 'both' ELSE 'neither' END AS outcome, count(*) AS n FROM labels GROUP BY 1")
def paired_outcomes(spark, sf_dir):
    x = table(spark, sf_dir, "labels")
    return T.paired_outcomes(x.select("doc_id", (F.col("quality") == 1).alias("right")), x.select("doc_id", (F.col("toxic") == 0).alias("right")), "doc_id", "right")


@query(
    f"""WITH {CHUNKS}, u AS (SELECT doc_id, ord FROM chunks WHERE ord = 2), h AS (SELECT c.doc_id, c.ord, len(regexp_extract_all(lower(c.text), 'the')) AS hits FROM chunks c WHERE c.n_chars >= 200 AND NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = c.doc_id AND abs(u.ord - c.ord) <= 1))
SELECT doc_id, ord, CAST(hits AS INTEGER) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ord) AS rn FROM h) WHERE rn = 1"""
)
def best_fragments(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return T.best_fragment(c, F.regexp_count(F.lower("text"), F.lit("the")), c.where("ord = 2").select("doc_id", "ord"), 200)


@query(
    """SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]{5,}(?: [A-Z][a-z]{5,})*')) AS word FROM documents WHERE lang = 'en') GROUP BY word HAVING count(DISTINCT doc_id) >= 2""".replace("\\\\", "\\")
)
def toponym_mining(spark, sf_dir):
    """Capitalised names with their frequency and documents."""
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    words = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\b[A-Z][a-z]{5,}(?: [A-Z][a-z]{5,})*)"), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("docs >= 2")


@query("SELECT lang, source, count(*) AS docs, CAST(sum(CAST(contains(lower(text), ' not ') AS INTEGER)) AS BIGINT) AS negated, CAST(sum(CAST(contains(lower(text), 'http') AS INTEGER)) AS BIGINT) AS linked FROM documents GROUP BY CUBE (lang, source)")
def cue_audit(spark, sf_dir):
    """Cue counts by language, source and over all."""
    low = F.lower("text")
    sums = lambda p: F.sum(F.contains(low, F.lit(p)).cast("int"))
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("docs"), sums(" not ").alias("negated"), sums("http").alias("linked"))
