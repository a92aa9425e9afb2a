"""Queries of the near-copy operators that the engine has of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.functions import text as X
from lithoframe.operators import minhash as M
from lithoframe.plans.catalog import query
from lithoframe.plans.views import CHUNKS, chunks, table

_SHINGLES = r"list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' ')) ELSE [] END)"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_PERM = "[" + ", ".join("{{'a': {}, 'b': {}}}".format(*M.permutation(k)) for k in range(M.PERMUTATIONS)) + "]"
_SIG = f"""hashed AS (SELECT doc_id, len(w) AS n, list_transform({_SHINGLES}, lambda s: CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) % {M.PRIME}) AS h FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE n_chars < 3000)),
sigs AS (SELECT doc_id, n, CASE WHEN len(h) > 0 THEN list_transform({_PERM}, lambda p: list_min(list_transform(h, lambda x: CAST((CAST(x AS HUGEINT) * p.a + p.b) % {M.PRIME} AS BIGINT)))) END AS sig FROM hashed)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")


@query(f"WITH {_SIG.replace(' WHERE n_chars < 3000', '')} SELECT doc_id AS id, array_to_string(sig, ' ') AS sig FROM sigs WHERE sig IS NOT NULL")
def minhash_signature(spark, sf_dir):
    s = M.signatures(_docs(spark, sf_dir), "id", F.col("text")).where("sig IS NOT NULL")
    return s.select("id", F.array_join(F.transform("sig", lambda x: x.cast("string")), " ").alias("sig"))


@query(
    f"""WITH {_SIG.replace(' WHERE n_chars < 3000', '')} SELECT band, count(*) AS buckets, max(n) AS largest FROM (SELECT band, array_to_string(list_slice(sig, band * 4 + 1, band * 4 + 4), '-') AS key, count(*) AS n
FROM (SELECT sig, CAST(unnest(range(16)) AS INTEGER) AS band FROM sigs WHERE sig IS NOT NULL) GROUP BY 1, 2) GROUP BY band"""
)
def lsh_bands(spark, sf_dir):
    s = M.signatures(_docs(spark, sf_dir), "id", F.col("text")).where("sig IS NOT NULL")
    return s.select(F.explode(M.bands(F.col("sig"))).alias("x")).groupBy("x.band", "x.key").count().groupBy("band").agg(F.count("*").alias("buckets"), F.max("count").alias("largest"))


@query(
    rf"""WITH s AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 20), keyed AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared FROM keyed x JOIN keyed y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT count(*) > 0 AS found FROM both_ WHERE shared / (na + nb - shared) >= 0.8"""
)
def near_duplicates_exist(spark, sf_dir):
    found = M.near_duplicates(_docs(spark, sf_dir)).where("original IS NOT NULL")
    return found.agg((F.count("*") > 0).alias("found"))


@query()
def near_duplicate_chunks(spark, sf_dir):
    """Every document with the earliest kept one that it nearly repeats."""
    return M.near_duplicates(_docs(spark, sf_dir))


_MARKS = {"negation": "nicht|never|sans", "numbers": r"\d+"}
_FOUND = r"list_sort(list_distinct(regexp_extract_all(lower({t}), '{p}')))"


@query(
    rf"""WITH p AS (SELECT a.doc_id, a.text AS t, b.text AS u FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
d AS (SELECT doc_id, {_FOUND.format(t='t', p=_MARKS['negation'])} <> {_FOUND.format(t='u', p=_MARKS['negation'])} AS n1, {_FOUND.format(t='t', p=_MARKS['numbers'])} <> {_FOUND.format(t='u', p=_MARKS['numbers'])} AS n2 FROM p)
SELECT doc_id, concat_ws(' ', CASE WHEN n1 THEN 'negation' END, CASE WHEN n2 THEN 'numbers' END) AS differences FROM d"""
)
def protected_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after"))
    return d.join(after, "doc_id").select("doc_id", F.array_join(M.protected_differences(F.col("text"), F.col("after"), _MARKS), " ").alias("differences"))


@query(
    rf"""WITH s AS (SELECT doc_id, {_SHINGLES} AS s, len(list_distinct(w)) AS terms FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
p AS (SELECT a.doc_id, a.terms, CASE WHEN len(list_distinct(list_concat(a.s, b.s))) > 0 THEN len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) ELSE 0 END AS j, x.text AS t, y.text AS u FROM s a JOIN s b ON b.doc_id = a.doc_id - a.doc_id % 5 JOIN documents x ON x.doc_id = a.doc_id JOIN documents y ON y.doc_id = b.doc_id),
q AS (SELECT *, {_FOUND.format(t='t', p=_MARKS['numbers'])} <> {_FOUND.format(t='u', p=_MARKS['numbers'])} AS differ FROM p)
SELECT doc_id, CASE WHEN j >= 0.8 AND differ THEN 'REVIEW_NOT_DROP' WHEN j >= 0.8 THEN 'DROP_DUPLICATE' WHEN terms < 40 THEN 'DROP_SPARSE' ELSE 'KEEP' END AS decision FROM q"""
)
def prefilter_decisions(spark, sf_dir):
    """Each document against the first of its five, with numbers protected."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", X.shingles(F.col("text")).alias("s"), F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))).alias("terms"))
    first = d.select(F.col("doc_id").alias("first"), F.col("text").alias("u"), F.col("s").alias("v"))
    met = d.join(first, F.col("first") == F.col("doc_id") - F.col("doc_id") % 5)
    differ = M.protected_differences(F.col("text"), F.col("u"), {"numbers": _MARKS["numbers"]})
    return met.select("doc_id", M.prefilter(X.jaccard(F.col("s"), F.col("v")), differ, F.col("terms"), least_terms=40).alias("decision"))


@query(
    f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT doc_id, md5(text) AS h FROM chunks WHERE n_chars >= 40), sizes AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(DISTINCT x.h) AS n FROM c x JOIN c y ON x.h = y.h AND x.doc_id > y.doc_id GROUP BY 1, 2),
e AS (SELECT s.a, s.b FROM shared s JOIN sizes p ON p.doc_id = s.a JOIN sizes q ON q.doc_id = s.b WHERE s.n / least(p.n, q.n) >= 0.3),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT a AS node, b AS seen FROM both_ UNION SELECT w.node, x.b FROM walk w JOIN both_ x ON x.a = w.seen)
SELECT d.doc_id, least(d.doc_id, coalesce(min(w.seen), d.doc_id)) AS family FROM documents d LEFT JOIN walk w ON w.node = d.doc_id GROUP BY d.doc_id"""
)
def source_families(spark, sf_dir):
    """Families of documents that share at least 0.3 of the smaller one's chunks."""
    c = chunks(spark, sf_dir)
    long = c.where("n_chars >= 40").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")).distinct()
    sizes = c.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    sizes = M.materialize(sizes, "sizes")
    return M.source_families(None, sizes, [M.sharing_links(long, sizes)])
