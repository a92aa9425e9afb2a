"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.plans.scratch import materialize

__all__ = ["LOWER", "UPPER", "WHITE", "ascii_lower", "collector_paused", "materialize", "small_batches", "table", "text_or_empty", "vote_columns", "vote_names", "voted_bits", "words"]

#: ASCII capitals and their lower-case forms, for translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Java pattern of the white space that separates words.
WHITE = "[\\x20\\x09-\\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space, in order; empty for none."""
    return F.array_remove(F.split(text, WHITE), "")


def vote_columns(hash_: Column, weight: Column | None = None, lanes: int = 2, name: str = "__v") -> list[Column]:
    """Aggregates that count, for each of 64 bits, the (weighted) hashes that set it.

    A long holds ``lanes`` counters: counter j of long k is for bit
    k + j * 64 / lanes.  A group's weights must sum to less than 2**(64 / lanes - 1).
    """
    width = 64 // lanes
    ones = sum(1 << (width * j) for j in range(lanes))
    votes = [F.shiftrightunsigned(hash_, k).bitwiseAND(F.lit(ones)) for k in range(width)]
    return [F.sum(x if weight is None else x * weight).alias(f"{name}{k}") for k, x in enumerate(votes)]


def vote_names(lanes: int = 2, name: str = "__v") -> list[str]:
    return [f"{name}{k}" for k in range(64 // lanes)]


def voted_bits(groups: Column, total: Column, lanes: int = 2, first: int = 0) -> Column:
    """The 64 bits that over half of ``total`` set, as a long.

    ``groups`` is an array of arrays of the longs of `vote_columns`, from
    position ``first`` on; their counters add up.  Written with lambdas and not
    as 64 expressions, which would make generated code too large to compile in
    an executor's memory.
    """
    width = 64 // lanes
    low = F.lit((1 << width) - 1)

    def count(bit: Column) -> Column:
        at, shift = (bit % width + first).cast("int"), (F.floor(bit / width) * width).cast("int")
        one = lambda g: F.call_function("shiftrightunsigned", F.coalesce(F.get(g, at), F.lit(0).cast("long")), shift).bitwiseAND(low)
        return F.aggregate(groups, F.lit(0).cast("long"), lambda s, g: s + one(g))

    bit = lambda out, k: out.bitwiseOR(F.when(count(k) * 2 > total, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends at most 8 MB of rows to Python at a time.

    Rows with long texts would otherwise be held in batches of up to 64 MB, in
    the executor and again in each of its Python workers.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


@contextmanager
def collector_paused() -> Iterator[None]:
    """No cyclic collection inside: for tasks whose large memory holds no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
