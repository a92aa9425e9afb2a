"""Indexes that grow by batches: near copies by stored bands, and components by stored roots.

Both keep their state in bucketed tables under a folder.  A batch is joined with the
state on the buckets' keys, so the state is read in place and never shuffled, and
what was joined before is not joined with itself again.  The folder can be opened by
a later session.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.operators import minhash as M
from lithoframe.operators.components import connected_components
from lithoframe.plans.scratch import append, bucketed_table, materialize

BUCKETS = 32


class CopyIndex:
    """Originals of near copies (`minhash.near_duplicates`), registered batch by batch.

    A row of a batch is a copy if an original that is registered already, or an
    earlier kept row of the batch, is similar to it; its original is the most similar
    of both kinds, of equal ones that of least id.  Other rows are registered.  Batches
    in order of id give the same as all rows at once.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", *, least: float = 0.8, least_words: int = 20, buckets: int = BUCKETS):
        self.spark, self.least, self.least_words = spark, least, least_words
        self.bands = bucketed_table(spark, f"{path}/bands", f"band INT, key STRING, id {id_type}, sig ARRAY<BIGINT>", ["band", "key"], buckets)

    def matches(self, reps: DataFrame) -> DataFrame:
        """(a, b, similarity) of registered originals a and rows b of ``reps`` (id, sig); only ``reps`` is shuffled."""
        stored = self.spark.table(self.bands).select("band", "key", F.col("id").alias("a"), F.col("sig").alias("s"))
        asked = M.keyed_bands(reps).select("band", "key", F.col("id").alias("b"), F.col("sig").alias("t"))
        met = asked.join(stored, ["band", "key"]).select("a", "b", M.estimate(F.col("s"), F.col("t")).alias("similarity"))
        return met.where(F.col("similarity") >= self.least).distinct()

    def add(self, batch: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
        """(id, original) of the batch's rows, null for those that are no copies; registers the kept ones."""
        signed = M.sign_long(batch, id_col, text_col, self.least_words)
        reps = materialize(signed.where("sig IS NOT NULL").groupBy("sig").agg(F.min("id").alias("id")).select("id", "sig"), "representatives")
        old = materialize(self.matches(reps), "old")
        pairs = materialize(M.similar_pairs(reps, self.least), "pairs")
        copies = old.select(F.col("b").alias("id")).distinct()
        fresh = reps.select("id").join(copies, "id", "left_anti")
        among = pairs.join(copies.select(F.col("id").alias("a")), "a", "left_anti").join(copies.select(F.col("id").alias("b")), "b", "left_anti")
        kept = materialize(M.first_kept(fresh, among).where("kept").select("id"), "kept")
        near = pairs.join(kept.select(F.col("id").alias("a")), "a", "left_semi").unionByName(old)
        best = near.groupBy(F.col("b").alias("id")).agg(F.min_by("a", F.struct(-F.col("similarity"), F.col("a"))).alias("best"))
        of = reps.join(kept.withColumn("kept", F.lit(True)), "id", "left").join(best, "id", "left").select("sig", F.when(F.col("kept"), F.col("id")).otherwise(F.col("best")).alias("to"))
        out = materialize(signed.join(of, "sig", "left").select("id", F.when(F.col("to") != F.col("id"), F.col("to")).alias("original")), "decided")
        append(M.keyed_bands(reps.join(kept, "id", "left_semi")).repartition(F.col("band"), F.col("key")), self.bands)
        return out


class ComponentIndex:
    """Connected components (`components.connected_components`) under growing edges.

    Stored are every node's root when it came, and where roots went since.  A batch's
    edges are put between the present roots, and the components of these few edges
    say which roots meet; no earlier edge is read and no stored node is rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, node_type: str = "string", *, buckets: int = BUCKETS):
        self.spark = spark
        self.nodes = bucketed_table(spark, f"{path}/nodes", f"node {node_type}, root {node_type}", ["node"], buckets)
        self.moves = bucketed_table(spark, f"{path}/moves", f"root {node_type}, component {node_type}, batch BIGINT", ["root"], buckets)

    def _now(self) -> DataFrame:
        """(root, component): where each root that ever moved is now, the latest entry of each."""
        return self.spark.table(self.moves).groupBy("root").agg(F.max_by("component", "batch").alias("component"))

    def current(self) -> DataFrame:
        """(node, component) of all nodes so far; a component's name is its smallest node."""
        return self.spark.table(self.nodes).join(self._now(), "root", "left").select("node", F.coalesce("component", "root").alias("component"))

    def add(self, edges: DataFrame, left: str = "a", right: str = "b") -> None:
        now = materialize(self._now(), "roots")
        number = (self.spark.table(self.moves).agg(F.max("batch")).first()[0] or 0) + 1
        pairs = materialize(edges.where(F.col(left) != F.col(right)).select(F.col(left).alias("a"), F.col(right).alias("b")).distinct(), "edges")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        placed = ends.join(self.spark.table(self.nodes), "node", "left").join(now, "root", "left")
        ends = materialize(placed.select("node", F.col("root").isNull().alias("new"), F.coalesce("component", "root", "node").alias("at")), "ends")
        x, y = ends.select(F.col("node").alias("a"), F.col("at").alias("ra")), ends.select(F.col("node").alias("b"), F.col("at").alias("rb"))
        joined = materialize(connected_components(pairs.join(x, "a").join(y, "b").select("ra", "rb"), "ra", "rb").where("node <> component").select(F.col("node").alias("root"), F.col("component").alias("to")), "joined")
        moved = now.join(joined.select(F.col("root").alias("component"), "to"), "component").select("root", F.col("to").alias("component"))
        fresh = ends.where("new").select(F.col("node").alias("root"))
        own = joined.join(fresh, "root", "left_anti").select("root", F.col("to").alias("component"))
        newcomers = ends.where("new").join(joined.select(F.col("root").alias("node"), "to"), "node", "left").select("node", F.coalesce("to", "node").alias("root"))
        moves, newcomers = materialize(moved.unionByName(own).withColumn("batch", F.lit(number).cast("bigint")), "moves"), materialize(newcomers, "newcomers")
        append(moves.repartition("root"), self.moves)
        append(newcomers.repartition("node"), self.nodes)
