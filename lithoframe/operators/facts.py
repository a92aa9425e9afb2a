"""Predicates, joins and aggregates over quoted facts.

A fact has id, doc_id, chunk_id, src, relation, dst, votes, stale, typed and
rel_type.  Pairs of ends are unordered: least and greatest of the two.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = (F.least, F.greatest)


def unordered(df: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    return df.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))


def with_accepted(facts: DataFrame, min_votes: int = 3, fresh: bool = False) -> DataFrame:
    """``accepted``: enough votes, or the unordered pair is stated by more than one document.

    With ``fresh``, stale facts are neither accepted nor a support for others.
    One aggregation on the pair instead of a lookup for each fact.
    """
    keyed = unordered(facts)
    live = keyed.where(~F.col("stale")) if fresh else keyed
    repeated = live.groupBy("lo", "hi").agg(F.count_distinct("doc_id").alias("__docs")).where("__docs > 1").select("lo", "hi", F.lit(True).alias("__rep"))
    voted = F.coalesce(F.col("votes"), F.lit(0)) >= min_votes
    flag = voted | F.coalesce("__rep", F.lit(False))
    if fresh:
        flag = flag & ~F.col("stale")
    return keyed.join(repeated, ["lo", "hi"], "left").withColumn("accepted", flag).drop("__rep", "lo", "hi")


def typed_only(facts: DataFrame) -> DataFrame:
    """Drop facts that were typed without a result; keep those never typed."""
    return facts.where(~(F.col("typed") & F.col("rel_type").isNull()))


def end_filter(facts: DataFrame, keys: Sequence[str] = (), patterns: Sequence[str] = (), both_ends: bool = False) -> DataFrame:
    """Facts whose ends are among the keys or contain a pattern; either end, or both."""

    def test(end: str) -> Column:
        parts = [F.col(end).isin(list(keys))] if keys else []
        parts += [F.contains(F.col(end), F.lit(p)) for p in patterns]
        return reduce(lambda x, y: x | y, parts) if parts else F.lit(True)

    return facts.where(test("src") & test("dst") if both_ends else test("src") | test("dst"))


def pair_degree(facts: DataFrame) -> DataFrame:
    """Distinct documents of every unordered pair of different ends."""
    return unordered(facts.where("src <> dst")).groupBy("lo", "hi").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("facts"))


def both_ends(facts: DataFrame) -> DataFrame:
    """Every fact once for each of its ends, as ``key``."""
    rest = [c for c in facts.columns if c not in ("src", "dst")]
    return facts.select(F.col("src").alias("key"), *rest).unionByName(facts.select(F.col("dst").alias("key"), *rest))


def top_keys(facts: DataFrame, n: int) -> DataFrame:
    """The n ends with most documents, then facts."""
    counted = both_ends(facts).groupBy("key").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("facts"))
    return counted.orderBy(F.desc("docs"), F.desc("facts"), "key").limit(n)


def most_common(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most frequent ``value`` of each key; the one seen first by ``order`` wins ties."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    return counted.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("__first"))).alias(value), F.sum("n").alias("n"), F.count("*").alias("spellings"))


def partners(facts: DataFrame, min_docs: int = 2) -> DataFrame:
    """Facts whose pair another document states too, in either direction."""
    keyed = unordered(facts)
    spread = keyed.groupBy("lo", "hi").agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") >= min_docs)
    return keyed.join(spread.select("lo", "hi"), ["lo", "hi"], "left_semi").drop("lo", "hi")


def link_quotes(facts: DataFrame, limit: int = 3) -> DataFrame:
    """Links (src, relation, dst) with counts and up to ``limit`` fact ids from different documents."""
    keys = ["src", "relation", "dst"]
    first = facts.groupBy(*keys, "doc_id").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    chosen = first.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
    return chosen.groupBy(*keys).agg(F.sum("n").alias("facts"), F.count("*").alias("docs"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= limit, F.col("id")))), lambda x: x.cast("string")), ",").alias("quotes"))


def stamp(facts: DataFrame) -> DataFrame:
    """One row that changes whenever the facts do; two equal stamps mean nothing to rebuild."""
    return facts.agg(
        F.count("*").alias("facts"), F.max("id").alias("last_id"), F.count("votes").alias("voted"), F.coalesce(F.sum("votes"), F.lit(0)).alias("votes"), F.count(F.when(F.col("typed"), 1)).alias("typed"), F.count("rel_type").alias("with_type")
    )


def conflict_pairs(facts: DataFrame, cap: int | None = None) -> DataFrame:
    """Pairs of distinct relations that are stated for the same ends, with one fact of each.

    Facts are collapsed to (ends, relation) first, so the self join is over
    distinct statements: a pair stated a million times still gives one row.
    """
    stated = facts.groupBy("src", "dst", "relation").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    a, b = stated.alias("a"), stated.alias("b")
    met = a.join(b, (F.col("a.src") == F.col("b.src")) & (F.col("a.dst") == F.col("b.dst")) & (F.col("a.relation") < F.col("b.relation")))
    return met.select("a.src", "a.dst", F.col("a.relation").alias("relation_a"), F.col("b.relation").alias("relation_b"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
