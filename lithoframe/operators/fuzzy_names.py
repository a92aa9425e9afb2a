"""Names of two sets that are spelled almost alike, found without all pairs.

The likeness of two keys is 2 m / n: n counts the letters of both, m those that the
longest common run matches, and again the longest ones before and after it.  Two keys of
at least some likeness leave at most D = n - 2 m letters unmatched, and D follows from
their lengths.  Of D + 1 pieces of one key at least one is therefore whole in the other
key, moved by no more than the letters that may be unmatched before it.  Pieces with
their place and both lengths are the keys of an equi-join, so no pair is lost.

Keys of more than `LONG` letters together would have too many pieces and places.  They
meet by runs of two or three letters instead: keys that must share some of their runs
share one of the first in any fixed order.

Pairs of a piece are dropped in the join where a 128-bit parity of the letters, or then
the edit distance, proves more than D unmatched ones; what is left is verified.  Equal keys are one row, so copies
make no pairs.  Crowded pieces are split: one side is dealt to parts of `CROWD` rows, the
other is sent to all of them.

Null and empty keys are like nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lithoframe.functions.text import translit_key
from lithoframe.operators.search import top_per_group
from lithoframe.plans.scratch import materialize

#: Letters of both keys together up to which pieces are used; rows of a crowded piece that one part takes.
LONG, CROWD = 64, 2048
LOWEST = 0.7


def needed(letters: int, least: float) -> int:
    """Letters that must match of so many of both keys."""
    return math.ceil(least * letters / 2 - 1e-9)


@lru_cache(256)
def partners(n: int, least: float) -> tuple[int, ...]:
    """Lengths of keys that can be alike to one of ``n`` letters."""
    most = math.floor(n * (2 - least) / least + 1e-9)
    return tuple(m for m in range(1, most + 1) if needed(n + m, least) <= min(n, m))


def pieces(n: int, count: int) -> list[tuple[int, int]]:
    """Starts and lengths of ``count`` pieces of nearly equal length."""
    edges = [n * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


@lru_cache(4096)
def stored_places(n: int, least: float) -> tuple[tuple[str, int, int], ...]:
    """Label, start and length of the pieces under which a key of ``n`` letters is stored."""
    spare = {n + m - 2 * needed(n + m, least) for m in partners(n, least) if n + m <= LONG}
    return tuple((f"{n} {d} {i} ", at, size) for d in sorted(spare) for i, (at, size) in enumerate(pieces(n, d + 1)))


@lru_cache(4096)
def asked_places(n: int, least: float) -> tuple[tuple[str, int, int], ...]:
    """Label, start and length of the runs by which a key of ``n`` letters finds stored pieces."""
    out = []
    for m in partners(n, least):
        if n + m > LONG:
            break
        d = n + m - 2 * needed(n + m, least)
        before, after = (d - (n - m)) // 2, (d + (n - m)) // 2
        for i, (at, size) in enumerate(pieces(m, d + 1)):
            out += [(f"{m} {d} {i} ", start, size) for start in range(max(0, at - before), min(n - size, at + after) + 1)]
    return tuple(out)


def long_runs(key: str, least: float) -> list[str]:
    """The runs by which a key meets others if both have more than `LONG` letters together."""
    n, q = len(key), 3 if least >= 0.84 else 2
    far = [n + m for m in partners(n, least) if n + m > LONG]
    if not far:
        return []
    shared = min((2 * q - 1) * needed(s, least) - (q - 1) * (s + 1) for s in far)
    seen: Counter[str] = Counter()
    runs = []
    for k in range(n - q + 1):
        run = key[k : k + q]
        runs.append(f"{run} {seen[run]}")
        seen[run] += 1
    return sorted(runs, key=xxhash.xxh64_intdigest)[: len(runs) - max(shared, 1) + 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parity(key: str) -> tuple[int, int]:
    """128 bits, of which a letter's k-th occurrence turns one over; keys differ in no more bits than letters."""
    bits, seen = 0, Counter()
    for c in key:
        bits ^= 1 << (xxhash.xxh64_intdigest(f"{c} {seen[c]}") & 127)
        seen[c] += 1
    return _signed(bits & ((1 << 64) - 1)), _signed(bits >> 64)


def meeting_points(key: str, least: float, stored: bool) -> list[int]:
    """Hashes of the pieces (or of the long runs) of a key, on the stored or on the asking side."""
    places = stored_places(len(key), least) if stored else asked_places(len(key), least)
    points = {xxhash.xxh64_intdigest(label + key[at : at + size]) for label, at, size in places}
    points |= {xxhash.xxh64_intdigest("long " + run) for run in long_runs(key, least)}
    return [_signed(p) for p in points]


def _placed(keys: DataFrame, least: float, stored: bool) -> DataFrame:
    """key, n, s0, s1 and point of each meeting point."""
    schema = StructType([StructField("key", StringType()), StructField("n", LongType()), StructField("s0", LongType()), StructField("s1", LongType()), StructField("points", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.column(0).slice(first, 256).to_pylist()
                bits = [parity(k) for k in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array([len(k) for k in part], pa.int64()), pa.array([x for x, _ in bits], pa.int64()), pa.array([y for _, y in bits], pa.int64()), pa.array([meeting_points(k, least, stored) for k in part], pa.list_(pa.int64()))],
                    names=schema.names,
                )

    return keys.mapInArrow(run, schema).select("key", "n", "s0", "s1", F.explode("points").alias("point"))


def ratio(a: Column, b: Column) -> Column:
    """Likeness of two keys."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b) of keys that meet and may be alike; ``right`` is stored by its pieces, so it should be the larger side."""
    asked, stored = _placed(left, least, False), materialize(_placed(right, least, True), "pieces")
    crowded = materialize(stored.groupBy("point").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts")).where("parts > 1"), "crowded")
    x = asked.join(crowded, "point", "left").select("point", *[F.col(c).alias(f"a_{c}") for c in ("key", "n", "s0", "s1")], F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    y = stored.join(crowded, "point", "left").select("point", *[F.col(c).alias(f"b_{c}") for c in ("key", "n", "s0", "s1")], F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    letters = F.col("a_n") + F.col("b_n")
    spare = letters - 2 * F.ceil(F.lit(least) * letters / 2 - 1e-9)
    apart = F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))) + F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1")))
    edits = F.call_function("levenshtein", "a_key", "b_key", spare.cast("int"))
    return x.join(y, ["point", "part"]).where(apart <= spare).where(edits >= 0).select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).distinct()


def alike_keys(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, ratio): pairs of different texts of the columns ``key`` of both sides with likeness ``least`` or more, each once.

    ``least`` must be at least `LOWEST`, below which short keys have no pieces.
    The likeness of a to b can differ from that of b to a where runs of one length tie.
    """
    if not LOWEST <= least <= 1:
        raise ValueError(f"least must lie between {LOWEST} and 1")
    one, two = (df.select("key").where("key <> ''").distinct() for df in (left, right))
    # Written first: the test of the likeness would otherwise go below the distinct and see a pair once for each piece.
    found = materialize(candidates(one, two, least), "candidates")
    return found.withColumn("ratio", ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)


def resolve_places(
    names: DataFrame, asked: DataFrame, *, similar: DataFrame | None = None, key: Callable[[Column], Column] = translit_key, least: float = 0.85, both: float = 0.6, most: int = 4
) -> DataFrame:
    """(place, name, score, pos): the ``most`` names closest to each place, for any number of places.

    ``asked`` has place and spelling, ``names`` name, ``similar`` (if given) place, name
    and similarity.  A name is close if one spelling's likeness reaches ``least``, or
    ``both`` together with the similarity; its score is the greatest likeness plus the
    similarity, if one is known.  Ties go by name; repeated rows count once.
    """
    keyed = materialize(names.select("name", key(F.col("name")).alias("key")).where("key <> ''").distinct(), "names")
    wanted = materialize(asked.select("place", key(F.col("spelling")).alias("key")).where("key <> ''").distinct(), "places")
    pairs = alike_keys(wanted, keyed, least)
    close = pairs.join(wanted.withColumnRenamed("key", "a"), "a").join(keyed.withColumnRenamed("key", "b"), "b").select("place", "name", "ratio")
    if similar is None:
        scored = close.groupBy("place", "name").agg(F.max("ratio").alias("score"))
    else:
        known = materialize(similar.groupBy("place", "name").agg(F.max("similarity").alias("near")), "similar")
        met = known.where(F.col("near") >= both).join(wanted, "place").join(keyed.withColumnRenamed("key", "other"), "name")
        also = met.select("place", "name", ratio(F.col("key"), F.col("other")).alias("ratio")).where(F.col("ratio") >= both)
        best = close.unionByName(also).groupBy("place", "name").agg(F.max("ratio").alias("ratio"))
        scored = best.join(known, ["place", "name"], "left").select("place", "name", (F.col("ratio") + F.coalesce("near", F.lit(0.0))).alias("score"))
    return top_per_group(scored.withColumn("score", F.round("score", 6)), "place", [F.desc("score"), F.col("name")], most, "pos").select("place", "name", "score", "pos")
