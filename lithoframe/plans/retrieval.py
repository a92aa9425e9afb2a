"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.operators import search as S
from lithoframe.operators.vector_index import knn_join as knn_join_in_blocks
from lithoframe.plans.catalog import query
from lithoframe.plans.views import table

_WORDS = ("the", "of", "and")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("doc_id"), "embedding")


def _first(spark, sf_dir):
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


def _texts(spark, sf_dir):
    """Documents stand for the chunks of the group that their vector's label names."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("doc_id")), "id")


_SIM = "round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6)"
_NEAR = f"""near AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS pos FROM (
  SELECT e.vec_id AS id, e.label AS doc_id, {_SIM} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q))"""
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _score_sql(words, text="text"):
    toks = _TOKENS.replace("(text)", f"({text})")
    hits = [f"len(list_filter({toks}, lambda w: w = '{w}'))" for w in words]
    return hits, "round(" + " + ".join(f"h{i} / (h{i} + 1.0::DOUBLE)" for i in range(len(words))) + ", 6)"


def _words_cte(words, need="AND"):
    hits, score = _score_sql(words)
    cols = ", ".join(f"{h} AS h{i}" for i, h in enumerate(hits))
    test = f" {need} ".join(f"h{i} > 0" for i in range(len(words)))
    return f"""words AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM (
  SELECT id, doc_id, {score} AS score FROM (SELECT d.doc_id AS id, e.label AS doc_id, {cols} FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id) WHERE {test}))"""


@query(f"WITH {_NEAR} SELECT id, doc_id, similarity, CAST(pos AS INTEGER) AS pos FROM near WHERE pos <= 20")
def top_k_cosine(spark, sf_dir):
    return S.vector_search(_vectors(spark, sf_dir), _first(spark, sf_dir), 20)


@query(f"WITH {_NEAR.replace('q))', 'q WHERE e.label = 3))')} SELECT id, doc_id, similarity, CAST(pos AS INTEGER) AS pos FROM near WHERE pos <= 10")
def filtered_top_k(spark, sf_dir):
    return S.vector_search(S.search_filter(_vectors(spark, sf_dir), doc_ids=3), _first(spark, sf_dir), 10)


@query(f"WITH {_words_cte(_WORDS)} SELECT id, score, CAST(pos AS INTEGER) AS pos FROM words WHERE pos <= 20")
def keyword_search(spark, sf_dir):
    return S.text_search(_texts(spark, sf_dir), _WORDS, 20).select("id", "score", "pos")


@query(f"WITH {_words_cte(('der', 'the', 'que'), 'OR')} SELECT id, score, CAST(pos AS INTEGER) AS pos FROM words WHERE pos <= 20")
def keyword_search_any_word(spark, sf_dir):
    return S.text_search(_texts(spark, sf_dir), ("der", "the", "que"), 20, any_word=True).select("id", "score", "pos")


@query(
    f"""WITH {_NEAR}, {_words_cte(_WORDS)}, lists AS (SELECT id, pos FROM near WHERE pos <= 50 UNION ALL SELECT id, pos FROM words WHERE pos <= 50)
SELECT id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score, count(*) AS lists FROM lists GROUP BY id"""
)
def rrf_fusion(spark, sf_dir):
    return S.rrf([S.vector_search(_vectors(spark, sf_dir), _first(spark, sf_dir), 50), S.text_search(_texts(spark, sf_dir), _WORDS, 50)])


_HYBRID = f"""WITH {_NEAR}, {_words_cte(_WORDS)}, a AS (SELECT * FROM near WHERE pos <= 50), b AS (SELECT * FROM words WHERE pos <= 50),
lists AS (SELECT id, pos FROM a UNION ALL SELECT id, pos FROM b),
fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score FROM lists GROUP BY id),
hits AS (SELECT f.id, coalesce(a.doc_id, b.doc_id) AS doc_id, f.score, a.similarity,
  CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN a.id IS NOT NULL THEN 'vector' ELSE 'text' END AS found_by
  FROM fused f LEFT JOIN a ON a.id = f.id LEFT JOIN b ON b.id = f.id WHERE b.id IS NOT NULL OR coalesce(a.similarity, 0) >= 0.1),
capped AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, id) > 2 AS spilled FROM hits)
SELECT id, doc_id, score, similarity, found_by, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (ORDER BY spilled, score DESC, id) AS place FROM capped) WHERE place <= 10"""


@query(_HYBRID)
def hybrid_search(spark, sf_dir):
    return S.hybrid_search(_vectors(spark, sf_dir), _texts(spark, sf_dir), _first(spark, sf_dir), _WORDS, min_similarity=0.1)


@query(
    f"""WITH {_NEAR} SELECT id, doc_id, similarity, spilled, CAST(place AS INTEGER) AS place FROM (
SELECT *, row_number() OVER (ORDER BY spilled, pos) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) > 2 AS spilled FROM near WHERE pos <= 50))"""
)
def per_doc_cap(spark, sf_dir):
    near = S.vector_search(_vectors(spark, sf_dir), _first(spark, sf_dir), 50)
    return S.cap_per_group(near, "doc_id", [F.col("pos")], 2).select("id", "doc_id", "similarity", "spilled", "place")


@query(f"WITH {_NEAR} SELECT id, doc_id, similarity, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, id) AS rn FROM near) WHERE rn <= 2")
def vector_top_n_per_doc(spark, sf_dir):
    near = _vectors(spark, sf_dir).withColumn("similarity", F.round(S.cosine(F.col("embedding"), _first(spark, sf_dir)), 6)).drop("embedding")
    return S.top_per_group(near, "doc_id", [F.desc("similarity"), F.col("id")], 2)


@query(f"WITH {_words_cte(_WORDS)} SELECT id, doc_id, score, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, id) AS rn FROM words) WHERE rn <= 2")
def lexical_top_n_per_doc(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    hits = texts.withColumn("h", S.word_hits(S.tokens(F.col("text")), _WORDS)).where(F.forall("h", lambda h: h > 0))
    scored = hits.withColumn("score", F.round(F.aggregate("h", F.lit(0.0), lambda s, h: s + h / (h + F.lit(1.0))), 6))
    return S.top_per_group(scored, "doc_id", [F.desc("score"), F.col("id")], 2).select("id", "doc_id", "score", "rn")


@query(f"WITH {_NEAR} SELECT id, doc_id, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS turn FROM near WHERE pos <= 60)")
def round_robin_turns(spark, sf_dir):
    near = S.vector_search(_vectors(spark, sf_dir), _first(spark, sf_dir), 60)
    return S.round_robin(near, "doc_id", [F.col("pos")]).select("id", "doc_id", "turn")


@query(
    f"""WITH {_NEAR}, seated AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM near WHERE pos <= 80)
SELECT id, doc_id, reserved, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY reserved DESC, pos) AS place FROM (SELECT *, rn <= 2 AS reserved FROM seated)) WHERE place <= 12"""
)
def part_quota_seats(spark, sf_dir):
    near = S.vector_search(_vectors(spark, sf_dir), _first(spark, sf_dir), 80)
    return S.part_quotas(near, "doc_id", [F.col("pos")], 12, 5).select("id", "doc_id", "reserved", "place")


@query(
    f"""WITH {_NEAR}, {_words_cte(_WORDS)}, runs AS (SELECT id, pos, similarity, FALSE AS strict FROM near WHERE pos <= 30 UNION ALL SELECT id, pos, CAST(NULL AS DOUBLE), TRUE FROM words WHERE pos <= 30)
SELECT id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score, max(similarity) AS similarity, bool_or(strict) AS strict FROM runs GROUP BY id"""
)
def merged_queries(spark, sf_dir):
    near = S.vector_search(_vectors(spark, sf_dir), _first(spark, sf_dir), 30).select("id", "pos", "similarity", F.lit(False).alias("strict"))
    words = S.text_search(_texts(spark, sf_dir), _WORDS, 30).select("id", "pos", F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("strict"))
    return S.merge_queries([near, words])


@query(
    r"""SELECT id, lang, share, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY share DESC, id) AS place FROM (
SELECT doc_id AS id, lang, round((CAST(contains(lower(text), 'license') OR contains(lower(text), 'licence') AS DOUBLE) + CAST(contains(lower(text), 'http') AS DOUBLE) + CAST(contains(lower(text), '@') AS DOUBLE)) / 3, 4) AS share FROM documents)) WHERE place <= 100"""
)
def concept_rerank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    return S.concept_rerank(docs, [("license", "licence"), ("http",), ("@",)], order_col="id").where("place <= 100").select("id", "lang", "share", "place")


@query(
    """SELECT q, i, similarity, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, i) AS pos FROM (
SELECT q.vec_id AS q, e.vec_id AS i, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)) WHERE pos <= 5"""
)
def knn_join(spark, sf_dir):
    """The five nearest vectors of every stated query (ids divisible by 100)."""
    vectors = _vectors(spark, sf_dir)
    return knn_join_in_blocks(vectors.where("id % 100 = 0"), vectors, 5).select("q", "i", "similarity", "pos")


@query(
    r"""SELECT doc_id, round(2.0::DOUBLE * CAST(contains(lower(source), 'src1') AS INTEGER) + 1.0 * (CAST(list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'the') AS INTEGER)), 6) AS score FROM documents
WHERE contains(lower(source), 'src1') OR list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'the')"""
)
def weighted_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    body = F.array_contains(S.tokens(F.col("text")), "the").cast("int")
    head = F.contains(F.lower("source"), F.lit("src1")).cast("int")
    return docs.select("doc_id", F.round(F.lit(2.0) * head + F.lit(1.0) * body, 6).alias("score")).where("score > 0")
