"""Upkeep of stored facts and their vectors, and checks of stored rows.

Edge cases: null keys are told apart from all others and match nothing; empty
inputs give empty results; of rows equal in a key the one of least ``id`` counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.text import first_reason


def save_facts(stored: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """The table after the facts of the chunks in ``done`` are replaced by ``new``.

    All have chunk_id; facts have id, src, relation and dst, of which a chunk keeps
    one of each.  A chunk without new facts loses its old ones.
    """
    rest = stored.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")
    first = Window.partitionBy("chunk_id", "src", "relation", "dst").orderBy("id")
    return rest.select(stored.columns).unionByName(new.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(stored.columns))


def rejection_notes(rejected: DataFrame, most: int = 40) -> DataFrame:
    """``chunk_id``, n and the first ``most`` reasons, in order of ``ord`` and reason, as one text.

    Only the reasons that are kept are gathered, so a chunk with very many stays bounded.
    """
    order = Window.partitionBy("chunk_id").orderBy("ord", "reason")
    numbered = rejected.withColumn("__n", F.row_number().over(order))
    some = F.sort_array(F.collect_list(F.when(F.col("__n") <= most, F.struct("__n", "reason"))))
    return numbered.groupBy("chunk_id").agg(F.count("*").alias("n"), F.array_join(F.transform(some, lambda x: x["reason"]), "; ").alias("reasons"))


def mark_skipped(passes: DataFrame, facts: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pass rows (chunk_id, reason) with those of ``skipped`` put in, and the facts of other chunks."""
    marks = skipped.groupBy("chunk_id").agg(F.min("reason").alias("reason"))
    kept = passes.join(marks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "reason")
    return kept.unionByName(marks.select("chunk_id", "reason")), facts.join(marks.select("chunk_id"), "chunk_id", "left_anti").select(facts.columns)


def vector_changes(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """``id`` and action (insert, update, delete) of what a vector table lacks, holds of another text, or holds in vain.

    Both have id and text; what is equal has no row, so an unchanged table is not touched.
    """
    w, h = wanted.select("id", F.col("text").alias("want")), have.select("id", F.col("text").alias("have"))
    both = w.withColumn("__w", F.lit(True)).join(h.withColumn("__h", F.lit(True)), "id", "full")
    action = F.when(F.col("__h").isNull(), "insert").when(F.col("__w").isNull(), "delete").when(~F.col("want").eqNullSafe(F.col("have")), "update")
    return both.select("id", action.alias("action")).where("action IS NOT NULL")


def recheck(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``rows`` with problem: the name of the first rule that a stored row breaks, or null."""
    return rows.withColumn("problem", first_reason(rules))


def about(facts: DataFrame, commodity: str, topic: str | None = None) -> DataFrame:
    """Facts whose ends or quote match ``commodity`` and, if given, whose quote matches ``topic`` (both Java patterns, any case)."""
    found = F.rlike(F.concat_ws(" ", "src", "dst", "quote"), F.lit("(?i)" + commodity))
    return facts.where(found if topic is None else found & F.rlike("quote", F.lit("(?i)" + topic)))


def tidy(chunks: DataFrame, facts: DataFrame, clean: Column, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk_id, text, changed) with ``clean`` as text, without those shorter than ``least``; and the facts whose quote still stands in their chunk."""
    cleaned = chunks.select("chunk_id", clean.alias("__t"), F.col("text").alias("__old")).where(F.length("__t") >= least)
    kept = cleaned.select("chunk_id", F.col("__t").alias("text"), (F.col("__t") != F.col("__old")).alias("changed"))
    standing = facts.join(kept.select("chunk_id", F.col("text").alias("__text")), "chunk_id").where(F.contains("__text", "quote"))
    return kept, standing.select(facts.columns)


def agreement(pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field``, n and share of rows in which ``field`` equals ``field``_gold (two nulls are equal)."""
    each = [F.struct(F.lit(f).alias("field"), F.col(f).eqNullSafe(F.col(f + "_gold")).cast("int").alias("same")) for f in fields]
    return pairs.select(F.explode(F.array(*each)).alias("x")).groupBy("x.field").agg(F.count("*").alias("n"), F.round(F.avg("x.same"), 6).alias("share"))


def threshold_grid(rows: DataFrame, kinds: Sequence[Sequence[str]], thresholds: Sequence[int]) -> DataFrame:
    """``kinds``, threshold, dropped rows and their facts for every set of kinds and threshold: one scan, a sum per cell.

    ``rows`` has kind, chars and facts; a row is dropped if its kind is in the set and it has fewer characters.
    """
    cells = [F.struct(F.lit("+".join(k)).alias("kinds"), F.lit(t).alias("threshold"), (F.col("kind").isin(*k) & (F.col("chars") < t)).alias("hit")) for k in kinds for t in thresholds]
    x = rows.select("facts", F.explode(F.array(*cells)).alias("c"))
    hit = lambda v: F.coalesce(F.sum(F.when(F.col("c.hit"), v)), F.lit(0)).cast("long")
    return x.groupBy("c.kinds", "c.threshold").agg(hit(F.lit(1)).alias("dropped"), hit(F.col("facts")).alias("facts"))


def foreign_citations(cited: DataFrame, regions: DataFrame) -> DataFrame:
    """Per answer: its cited documents of its own target region, of another, and of none known.

    ``cited`` has answer, target and doc_id; ``regions`` has doc_id and region.
    """
    met = cited.join(regions.select("doc_id", "region"), "doc_id", "left")
    kind = F.when(F.col("region").isNull(), "unknown").when(F.col("region") == F.col("target"), "own").otherwise("foreign")
    named = met.select("answer", "target", "doc_id", kind.alias("kind")).distinct()
    return named.groupBy("answer", "target").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("own", "foreign", "unknown")])


def document_variant(letters: Column, garbage: Column, marked: Column, hyphens: Column, *, least_letters: int = 50, most_garbage: float = 0.1, most_hyphens: float = 0.05) -> Column:
    """scan, broken, marked, hyphenated or plain: how a document's pages want to be read, by what was measured on them."""
    return first_reason([("scan", letters < least_letters), ("broken", garbage > most_garbage), ("marked", marked), ("hyphenated", hyphens > most_hyphens)], "plain")
