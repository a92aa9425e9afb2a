"""Vector, keyword and hybrid retrieval over DataFrames.

Queries are small driver-side values (a vector, a list of words); everything
that touches the corpus is a scan with a bounded top-k (TakeOrderedAndProject)
or a partitioned aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """Cosine similarity of two arrays; null for a zero or null vector."""
    if not isinstance(b, Column):
        b = F.array(*[F.lit(float(x)) for x in b])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def search_filter(df: DataFrame, *, year_from: int | None = None, source: str | None = None, doc_ids: int | Sequence[int] | None = None) -> DataFrame:
    """Conjunction of the filters that are given; columns year, source and doc_id."""
    tests = []
    if year_from is not None:
        tests.append(F.col("year") >= year_from)
    if source is not None:
        tests.append(F.col("source") == source)
    if doc_ids is not None:
        tests.append(F.col("doc_id").isin([doc_ids] if isinstance(doc_ids, int) else list(doc_ids)))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def vector_search(df: DataFrame, vector: Sequence[float], k: int, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to ``vector`` with similarity and 1-based position; exact."""
    near = df.withColumn("similarity", F.round(cosine(F.col(vector_col), vector), 6)).where("similarity IS NOT NULL")
    return ranked(near.drop(vector_col).orderBy(F.desc("similarity"), id_col).limit(k), [F.desc("similarity"), F.col(id_col)])


def ranked(top: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """1-based positions of an already small (top-k) frame."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def word_hits(words: Column, query: Sequence[str]) -> Column:
    """Array of the occurrences of each query word."""
    return F.array(*[F.size(words) - F.size(F.array_remove(words, q)) for q in query])


def text_search(df: DataFrame, query: Sequence[str], k: int, *, id_col: str = "id", text_col: str = "text", any_word: bool = False) -> DataFrame:
    """Top k rows by keyword score; all words must occur unless ``any_word``.

    Score: sum over words of hits / (hits + 1), which grows with coverage first.
    """
    hits = df.withColumn("__h", word_hits(tokens(F.col(text_col)), query))
    present = F.exists if any_word else F.forall
    matched = hits.where(present("__h", lambda h: h > 0))
    scored = matched.withColumn("score", F.round(F.aggregate("__h", F.lit(0.0), lambda s, h: s + h / (h + F.lit(1.0))), 6)).drop("__h")
    return ranked(scored.orderBy(F.desc("score"), id_col).limit(k), [F.desc("score"), F.col(id_col)])


def weighted_text_search(df: DataFrame, query: Sequence[str], weights: dict[str, float], k: int, *, id_col: str = "id") -> DataFrame:
    """Top k rows by a weighted sum over fields of the query words they contain."""
    score = sum((F.aggregate(F.transform(word_hits(tokens(F.col(c)), query), lambda h: (h > 0).cast("double")), F.lit(0.0), lambda s, v: s + v) * w for c, w in weights.items()), F.lit(0.0))
    scored = df.withColumn("score", F.round(score, 6)).where("score > 0")
    return ranked(scored.orderBy(F.desc("score"), id_col).limit(k), [F.desc("score"), F.col(id_col)])


def rrf(lists: Sequence[DataFrame], *, id_col: str = "id", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of frames with ``id_col`` and ``pos``: id, score, lists."""
    parts = [x.select(id_col, "pos", F.lit(i).alias("__list")) for i, x in enumerate(lists)]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(id_col).agg(F.round(F.sum(F.lit(1.0) / (k + F.col("pos"))), 9).alias("score"), F.count_distinct("__list").alias("lists"))


def cap_per_group(df: DataFrame, group: str, order: list[Column], cap: int) -> DataFrame:
    """New order ``place``: the first ``cap`` rows of a group keep their order, the others follow; cap <= 0 keeps all."""
    within = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    spilled = (within > cap) if cap > 0 else F.lit(False)
    return ranked(df.withColumn("spilled", spilled), [F.col("spilled"), *order], "place")


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(name) <= n)


def round_robin(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``turn`` within the group; the i-th of every group comes before any (i + 1)-th."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def part_quotas(df: DataFrame, part: str, order: list[Column], limit: int, parts: int) -> DataFrame:
    """Every part first gets max(2, (limit - 2) // parts) places, the rest goes by order; at most ``limit`` rows."""
    seats = max(2, (limit - 2) // max(parts, 1))
    seated = top_per_group(df, part, order, limit, "__rn").withColumn("reserved", F.col("__rn") <= seats).drop("__rn")
    top = seated.orderBy(F.desc("reserved"), *order).limit(limit)
    return ranked(top, [F.desc("reserved"), *order], "place")


def passes(strict: Column, similarity: Column, min_similarity: float, require_words: bool) -> Column:
    """A strict word match always passes; otherwise the similarity decides, unless words are required."""
    strict = F.coalesce(strict, F.lit(False))
    return strict if require_words else strict | (F.coalesce(similarity, F.lit(0.0)) >= min_similarity)


def _fetched(top: DataFrame) -> DataFrame:
    """A top-k result as a local table, so that later uses do not scan the corpus again."""
    kept = top.select("id", "doc_id", "pos", *[c for c in ("similarity",) if c in top.columns])
    return top.sparkSession.createDataFrame(kept.collect(), kept.schema)


def hybrid_search(
    vectors: DataFrame, texts: DataFrame | Callable[[int, bool], DataFrame], vector: Sequence[float], query: Sequence[str], *, limit: int = 10, candidates: int = 50, k: int = 60, max_per_doc: int = 2, min_similarity: float = 0.0, require_words: bool = False
) -> DataFrame:
    """Vector and keyword candidates fused by reciprocal rank, filtered, capped per document.

    ``vectors`` (id, doc_id, embedding) and ``texts`` (id, doc_id, text), or instead of
    texts a function of (k, any_word) that gives the top k of the keyword search (id,
    doc_id, pos), from an index, say.  With no strict match and at least three words, keyword search falls back to any
    word.  Columns: id, doc_id, score, similarity, found_by, place.
    """
    keywords = texts if callable(texts) else lambda k, any_word: text_search(texts, query, k, any_word=any_word)
    near = _fetched(vector_search(vectors, vector, candidates))
    words = _fetched(keywords(candidates, False))
    strict = True
    if len(query) >= 3 and not words.count():
        words, strict = _fetched(keywords(candidates, True)), False
    score = rrf([near, words], k=k)
    both = score.join(F.broadcast(near.select("id", F.col("doc_id").alias("__d1"), "similarity")), "id", "left").join(F.broadcast(words.select("id", F.col("doc_id").alias("__d2"), F.lit(strict).alias("strict"))), "id", "left")
    found = F.when(F.col("__d1").isNotNull() & F.col("__d2").isNotNull(), "both").when(F.col("__d1").isNotNull(), "vector").otherwise("text")
    hits = both.withColumn("doc_id", F.coalesce("__d1", "__d2")).withColumn("found_by", found).where(passes(F.col("strict"), F.col("similarity"), min_similarity, require_words))
    return cap_per_group(hits, "doc_id", [F.desc("score"), F.col("id")], max_per_doc).where(F.col("place") <= limit).select("id", "doc_id", "score", "similarity", "found_by", "place")


def merge_queries(runs: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """Several queries' results (id, pos, similarity, strict) as one: summed RRF, best similarity, any strict."""
    every = reduce(DataFrame.unionByName, runs)
    return every.groupBy("id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("pos"))), 9).alias("score"), F.max("similarity").alias("similarity"), F.bool_or("strict").alias("strict"))


def neighbours(df: DataFrame, *, doc: str = "doc_id", order: str = "ord", text: str = "text", section: str | None = None) -> DataFrame:
    """Text of the previous and next chunk of the same document (and section)."""
    w = Window.partitionBy(doc, *([section] if section else [])).orderBy(order)
    near = lambda f, step: F.when(f(order).over(w) == F.col(order) + step, f(text).over(w))
    return df.withColumn("before", near(F.lag, -1)).withColumn("after", near(F.lead, 1))


def concept_rerank(hits: DataFrame, concepts: Sequence[Sequence[str]], *, text_col: str = "text", order_col: str = "pos") -> DataFrame:
    """Stable reorder by the share of concepts (lists of spellings) that a text names."""
    low = F.lower(F.col(text_col))
    named = [reduce(lambda a, b: a | b, [F.contains(low, F.lit(s.lower())) for s in c]).cast("double") for c in concepts]
    return ranked(hits.withColumn("share", F.round(sum(named, F.lit(0.0)) / len(concepts), 4)), [F.desc("share"), F.col(order_col)], "place")
