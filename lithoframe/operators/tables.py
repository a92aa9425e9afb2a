"""Keeping tables up to date: merges, replacements, deletions, logs and work lists.

Parquet has no update in place, so each operator returns the new table (or the
rows to insert, update and delete) and leaves writing to the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with equal keys."""
    kept = current.join(changes.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def replacement_plan(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keep, update, insert or delete for every key of either side."""
    o = old.select(*keys, F.col(value).alias("__o"), F.lit(True).alias("__in_old"))
    n = new.select(*keys, F.col(value).alias("__n"), F.lit(True).alias("__in_new"))
    action = F.when(F.col("__in_old").isNull(), "insert").when(F.col("__in_new").isNull(), "delete").when(F.col("__o").eqNullSafe(F.col("__n")), "keep").otherwise("update")
    return o.join(n, list(keys), "full_outer").select(*keys, action.alias("action"))


def latest(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    """The last record of every key, as of a journal in which later lines win."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def todo(source: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` that no row of ``done`` answers."""
    return source.join(done.select(*keys).distinct(), list(keys), "left_anti")


def todo_with_retry(source: DataFrame, done: DataFrame, key: str, reason: str = "skipped") -> DataFrame:
    """As `todo`, and rows skipped as a copy of another whose own pass has gone.

    The reason ends in the other row's key.
    """
    original = F.regexp_extract(F.col(reason), "([0-9]+)$", 1)
    copies = done.where(F.col(reason).isNotNull() & (original != "")).select(F.col(key), original.cast("long").alias("__of"))
    orphans = copies.join(done.select(F.col(key).alias("__of")), "__of", "left_anti").select(key)
    return todo(source, done.join(orphans, key, "left_anti"), [key])


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def mark_stale(facts: DataFrame, texts: DataFrame, *, key: str = "chunk_id", quote: str = "quote", text: str = "text") -> DataFrame:
    """Facts with ``found`` and their new stale flag: quotes are compared without case and white space runs."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    joined = facts.join(texts.select(key, F.col(text).alias("__t")), key, "left")
    found = F.coalesce(F.contains(plain(F.col("__t")), plain(F.col(quote))), F.lit(False))
    return joined.withColumn("found", found).withColumn("stale_now", ~found).drop("__t")


def fingerprint(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """SHA-256 of a group's texts, white space collapsed, joined by line ends in order."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("t")))), lambda x: x.t)
    return df.groupBy(group).agg(F.sha2(F.array_join(parts, "\n"), 256).alias("fingerprint"), F.count("*").alias("parts"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free hash of all rows: sums of row hashes, no sort and no gathering."""
    row = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("hash"))


def first_by_hash(df: DataFrame, content: Column, id_col: str) -> DataFrame:
    """``first_id`` of the rows with the same content, and whether a row is a copy of another."""
    hashed = df.withColumn("__h", F.sha2(content.cast("binary"), 256))
    first = hashed.groupBy("__h").agg(F.min(id_col).alias("first_id"))
    return hashed.join(first, "__h").withColumn("copy", F.col(id_col) > F.col("first_id")).drop("__h")


def read_overrides(log: DataFrame) -> DataFrame:
    """The state of an append-only log: last status of each decision, and how many events led there."""
    return log.groupBy("decision_id").agg(F.max_by("new_status", "at").alias("status"), F.max_by("reason", "at").alias("reason"), F.count("*").alias("events"))


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing columns as nulls; repeatable."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def has_columns(df: DataFrame, columns: Sequence[str]) -> bool:
    return set(columns) <= set(df.columns)
