"""Cosine similarity join without all pairs, and automatic synonyms on top of it.

Signs of random projections agree with probability 1 - angle / pi.  Rows that share
all bits of one band of signs are candidates; the bits of a band follow the number
of rows, so that a bucket of unrelated rows stays small, and the number of bands the
wanted recall at the least similarity.  Candidates whose sketches differ too much are
dropped in the join, and the rest are verified with the vectors themselves.

Equal vectors are one row (`distinct_vectors`), so copies make no pairs.  What is left
of a crowded bucket is split: one side is dealt to as many parts as the bucket has
blocks of `CROWD` rows, the other is sent to all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lithoframe.operators.search import cosine, top_per_group
from lithoframe.operators.vector_index import unit_rows
from lithoframe.plans.scratch import materialize

#: Rows wanted in a bucket, rows of a bucket that one part takes, and words of 64 signs in a sketch.
BUCKET, CROWD, WORDS = 64, 2048, 2


def plan_bands(rows: int, least: float, miss: float) -> tuple[int, int]:
    """Bits of a band and number of bands: a pair of similarity ``least`` is missed with probability ``miss`` at most."""
    bits = min(30, max(4, math.ceil(math.log2(max(2.0, rows / BUCKET)))))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree)) if agree < 1 else 1


def sketch_limit(least: float) -> int:
    """Differing signs of a sketch that a pair of similarity ``least`` exceeds only at four standard deviations."""
    share, n = math.acos(least) / math.pi, 64 * WORDS
    return math.ceil(n * share + 4 * math.sqrt(n * share * (1 - share)))


def distinct_vectors(df: DataFrame, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(v, id, members): every distinct vector with its least id and the number of rows that have it."""
    return df.where(F.col(vector_col).isNotNull()).groupBy(F.col(vector_col).alias("v")).agg(F.min(id_col).alias("id"), F.count("*").alias("members"))


def _signs(rows: DataFrame, bits: int, bands: int) -> DataFrame:
    """id, sketch and keys (one for each band) of rows (id, v) that have a direction."""
    schema = StructType([rows.schema["id"], StructField("sketch", ArrayType(LongType())), StructField("keys", ArrayType(LongType()))])
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            for first in range(0, b.num_rows, 1024):
                part = b.slice(first, 1024)
                x, good = unit_rows(part.column(1), None)
                x = x[good]
                if planes is None or planes.shape[0] != x.shape[1]:
                    planes = np.random.default_rng(17).standard_normal((x.shape[1], 64 * WORDS + bits * bands))
                on = x @ planes > 0
                sketch = np.packbits(on[:, : 64 * WORDS], axis=1).view(np.int64) if len(x) else np.empty((0, WORDS), np.int64)
                keys = on[:, 64 * WORDS :].reshape(len(x), bands, bits) @ weights
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), pa.int64())) for m in (sketch, keys)]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), *lists], names=schema.names)

    return rows.select("id", "v").mapInArrow(run, schema)


def candidates(rows: DataFrame, least: float, miss: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows (id, v) that share a bucket and whose sketches are close enough."""
    bits, bands = plan_bands(rows.count(), least, miss)
    signs = materialize(_signs(rows, bits, bands).withColumn("n", F.monotonically_increasing_id()), "signs")
    keyed = signs.select("n", *[F.col("sketch")[k].alias(f"s{k}") for k in range(WORDS)], F.posexplode("keys").alias("band", "key"))
    keyed = keyed.select(F.xxhash64("band", "key").alias("bucket"), "n", *[f"s{k}" for k in range(WORDS)])
    crowded = materialize(keyed.groupBy("bucket").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts")).where("parts > 1"), "crowded")
    parts = keyed.join(crowded, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = parts.select("bucket", F.col("n").alias("a"), *[F.col(f"s{k}").alias(f"x{k}") for k in range(WORDS)], F.pmod(F.xxhash64("n"), F.col("parts")).cast("int").alias("part"))
    y = parts.select("bucket", F.col("n").alias("b"), *[F.col(f"s{k}").alias(f"y{k}") for k in range(WORDS)], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    apart = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(WORDS)), F.lit(0))
    met = x.join(y, ["bucket", "part"]).where((F.col("a") < F.col("b")) & (apart <= sketch_limit(least))).select("a", "b").distinct()
    ids = signs.select("n", "id")
    named = met.join(ids.select(F.col("n").alias("a"), F.col("id").alias("p")), "a").join(ids.select(F.col("n").alias("b"), F.col("id").alias("q")), "b")
    return named.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def cosine_join(rows: DataFrame, least: float, miss: float = 0.001) -> DataFrame:
    """(a, b, similarity), a < b: pairs of distinct vectors (`distinct_vectors`) of cosine ``least`` or more.

    A pair of exactly ``least`` is missed with probability ``miss``, nearer ones less often.
    """
    found = materialize(candidates(rows, least, miss), "candidates")
    x, y = rows.select(F.col("id").alias("a"), F.col("v").alias("va")), rows.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    checked = found.join(x, "a").join(y, "b").select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))
    return checked.where(F.col("similarity") >= least)


def exact_join(df: DataFrame, least: float, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, similarity), a < b: all pairs of rows of cosine ``least`` or more, for any ``least``.

    Every row meets every other one, in pairs of blocks of about `CROWD` rows, each
    a task of its own; use `cosine_join` where ``least`` is high.
    """
    blocks = max(1, -(-df.count() // CROWD))
    dealt = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))
    left = dealt.select("id", "v", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("j"))
    right = dealt.select("id", "v", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"))
    schema = StructType([StructField("a", df.schema[id_col].dataType), StructField("b", df.schema[id_col].dataType), StructField("similarity", DoubleType())])

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        x, y = (unit_rows(t["v"].combine_chunks(), None) if len(t) else (np.empty((0, 0)), np.empty(0, bool)) for t in (one, two))
        p, q = np.flatnonzero(x[1]), np.flatnonzero(y[1])
        found = []
        for at in range(0, len(p) if len(q) and x[0].shape[1] == y[0].shape[1] else 0, 256):
            s = np.round(x[0][p[at : at + 256]] @ y[0][q].T, 6)
            r, c = np.nonzero(s >= least)
            found.append((p[at + r], q[c], s[r, c]))
        r, c, s = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        a, b = one["id"].take(pa.array(r)), two["id"].take(pa.array(c))
        same = len(one) and len(two) and one["i"][0] == two["j"][0]
        out = pa.table([a if same else pc.if_else(pc.less(a, b), a, b), b if same else pc.if_else(pc.less(a, b), b, a), pa.array(s, pa.float64())], names=schema.names)
        return out.filter(pc.less(out["a"], out["b"]))

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, schema)


def merge_names(names: DataFrame, pairs: DataFrame, guard: Column, nearest: int = 5) -> DataFrame:
    """(id, canon, similarity): names that become spellings of more frequent ones.

    ``names`` has id, name and times; names come by falling frequency, then id.  Of
    the ``nearest`` earlier names that ``pairs`` (a, b, similarity) gives, the first
    that ``guard`` (a condition on the columns name and other) allows is the one that a
    name follows, down to a name that follows none.  Similarity is null for those.
    """
    ranks = names.select("id", "name", F.struct((-F.col("times")).alias("t"), "id").alias("rank"))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("near"), "similarity").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("near"), "similarity"))
    met = both.join(ranks, "id").join(ranks.select(F.col("id").alias("near"), F.col("name").alias("other"), F.col("rank").alias("earlier")), "near").where("earlier < rank")
    close = top_per_group(met, "id", [F.desc("similarity"), F.col("earlier")], nearest)
    chosen = close.where(guard).groupBy("id").agg(F.min_by(F.struct("near", "similarity"), "rn").alias("x")).select("id", F.col("x.near").alias("canon"), "x.similarity")
    now = materialize(chosen, "followed")
    while True:
        onward = now.select(F.col("id").alias("canon"), F.col("canon").alias("next"))
        stepped = materialize(now.join(onward, "canon", "left").select("id", F.coalesce("next", "canon").alias("canon"), "similarity", F.col("next").isNotNull().alias("moved")), "followed")
        now = stepped.drop("moved")
        if not stepped.where("moved").limit(1).count():
            break
    return names.select("id").join(now, "id", "left").select("id", F.coalesce("canon", "id").alias("canon"), "similarity")
