"""Incremental passes as Structured Streaming: resumable work, counters, growing graphs.

Every pass reads a file stream with an available-now trigger: it takes what is
new since its checkpoint, writes, and stops.  Running it again after a failure
or with more files continues where it ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.operators.tables import upsert
from lithoframe.plans.scratch import new_path


def stream(spark: SparkSession, folder: str, file: str, schema) -> DataFrame:
    """The Parquet files of a folder that match a name, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).option("recursiveFileLookup", "true").parquet(folder)


def run_available(writer, checkpoint: str) -> None:
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def counter_table(events: DataFrame, keys: list[str], newest: str, order: str, target: str, checkpoint: str) -> None:
    """Times seen and newest value of every key, as a table that each batch brings up to date."""
    counted = events.groupBy(*keys).agg(F.count("*").alias("times"), F.max_by(newest, order).alias(newest), F.max(order).alias(order))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={number}")

    run_available(counted.writeStream.outputMode("complete").foreachBatch(save), checkpoint)


def latest_version(spark: SparkSession, target: str) -> DataFrame:
    every = spark.read.parquet(target)
    last = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == last).drop("version")


def resumable_pass(source: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Apply ``work`` to every new row once and append its results."""

    def save(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_available(source.writeStream.foreachBatch(save), checkpoint)


def extend_links(links: DataFrame, new_facts: DataFrame) -> DataFrame:
    """Links (src, relation, dst, facts, last_id) with the counts of new facts added; nothing old is read again."""
    added = new_facts.groupBy("src", "relation", "dst").agg(F.count("*").alias("facts"), F.max("id").alias("last_id"))
    both = links.select("src", "relation", "dst", "facts", "last_id").unionByName(added)
    return both.groupBy("src", "relation", "dst").agg(F.sum("facts").alias("facts"), F.max("last_id").alias("last_id"))


def can_extend(old: DataFrame, now: DataFrame) -> bool:
    """True if the stamp of the facts up to the old last id is unchanged, so that only new ones need adding."""
    a, b = old.first(), now.first()
    return a is not None and b is not None and a.asDict() == b.asDict()


def reuse_notes(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """``reuse``: whether a subject's cached notes of the same version cover all chunks it needs."""
    met = wanted.join(cached.select("subject", F.col("chunks").alias("__have"), F.col("version").alias("__v")), "subject", "left")
    covered = F.size(F.array_except("chunks", F.coalesce("__have", F.array().cast("array<bigint>")))) == 0
    return met.select("subject", (covered & F.coalesce(F.col("__v") == F.col("version"), F.lit(False))).alias("reuse"))


def warm_queue(asked: DataFrame, mentioned: DataFrame, limit: int) -> DataFrame:
    """Subjects to prepare: asked ones by frequency, then the most mentioned; each once."""
    every = asked.select("subject", F.lit(0).alias("part"), F.col("times").alias("weight")).unionByName(mentioned.select("subject", F.lit(1).alias("part"), F.col("docs").alias("weight")))
    first = every.groupBy("subject").agg(F.min(F.struct("part", -F.col("weight"))).alias("k"))
    return first.orderBy("k", "subject").limit(limit).select("subject", F.col("k.part").alias("part"))


def windowed_counts(events: DataFrame, length: str, late: str, target: str, checkpoint: str) -> None:
    """Events by tumbling window and type, with a watermark for late ones (an extension)."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))

    def save(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), "event_type", "n").write.mode("overwrite").parquet(f"{target}/version={number}")

    run_available(counted.writeStream.outputMode("complete").foreachBatch(save), checkpoint)


__all__ = ["can_extend", "counter_table", "extend_links", "latest_version", "new_path", "resumable_pass", "reuse_notes", "run_available", "stream", "upsert", "warm_queue", "windowed_counts"]
