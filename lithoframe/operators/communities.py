"""Communities of a weighted graph by modularity: local moving, refinement, aggregation, level by level.

Local moving takes all nodes at once.  In each round a hash picks half of the nodes,
and each of these goes to the neighbouring community that raises the modularity most,
if any does; the other half stays, so that neighbours don't swap places for ever.
Refinement then splits each community: from single nodes on, nodes that are still
alone join a part of their community that has an edge to them and whose nodes all
stay this round, so every part is connected.  The parts are the nodes of the next
level, which starts from the communities.  A level that doesn't raise the modularity
is not kept, and ends the search.

A round is a few equi-joins and aggregations with partial sums; its labels are a
table in the shared folder.  Only sums over the whole graph reach the driver.  With
whole-number weights the result does not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.operators.search import top_per_group
from lithoframe.plans.scratch import materialize

#: Rounds of moving and of refinement in a level, and levels; a gain below this, in units of weight, is none.
MOVES, REFINES, LEVELS, LEAST_GAIN = 8, 4, 8, 1e-9


def _turn(node: str, number: int) -> Column:
    """Whether a node may move in a round."""
    return F.pmod(F.xxhash64(node, F.lit(number)), F.lit(2)) == 0


def _both(edges: DataFrame) -> DataFrame:
    """(a, b, w): every edge in both directions once, ends that differ."""
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return ways.where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"))


def _pull(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, w): weight from every node to every neighbouring label."""
    return both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("w").alias("w"))


def _move(both: DataFrame, labels: DataFrame, doubled: float, number: int) -> DataFrame:
    """``labels`` (node, k, label) after one round, with ``moved``."""
    tot = labels.groupBy("label").agg(F.sum("k").alias("tot"))
    own = labels.join(tot, "label").select("node", "k", F.col("label").alias("own"), F.col("tot").alias("own_tot")).where(_turn("node", number))
    met = _pull(both, labels).join(tot, "label").join(own, "node")
    gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)) / doubled
    best = met.withColumn("gain", gain).groupBy("node").agg(
        F.max_by(F.struct("label", "gain"), F.struct("gain", F.xxhash64("label"), "label")).alias("best"),
        F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).alias("stay"),
        F.first("own").alias("own"),
        (-F.first("k") * (F.first("own_tot") - F.first("k")) / doubled).alias("alone"),
    )
    better = best.where((F.col("best.label") != F.col("own")) & (F.col("best.gain") > F.coalesce("stay", "alone") + LEAST_GAIN)).select("node", F.col("best.label").alias("to"))
    return labels.join(better, "node", "left").select("node", "k", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved"))


def _refine(both: DataFrame, labels: DataFrame, doubled: float) -> DataFrame:
    """(node, k, label, part): connected parts of the communities."""
    sides = labels.select("node", "label")
    inside = materialize(both.join(sides.withColumnRenamed("node", "a"), "a").join(sides.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").where("label = other").select("a", "b", "w"), "inside")
    parts = materialize(labels.select("node", "k", "label", F.col("node").alias("part")), "parts")
    for number in range(REFINES):
        sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("k").alias("tot"), F.bool_or(_turn("node", number)).alias("turn"))
        movers = parts.join(sizes, "part").where("n = 1 AND turn").select("node", "k")
        stays = sizes.where("n > 1 OR NOT turn").select(F.col("part").alias("label"), "tot")
        met = _pull(inside.join(movers.select(F.col("node").alias("a")), "a", "left_semi"), parts.select("node", F.col("part").alias("label"))).join(stays, "label").join(movers, "node")
        gain = F.col("w") - F.col("k") * F.col("tot") / doubled
        best = met.withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN).groupBy("node").agg(F.max_by("label", F.struct("gain", F.xxhash64("label"), "label")).alias("to"))
        now = materialize(parts.join(best, "node", "left").select("node", "k", "label", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().alias("moved")), "parts")
        parts = now.drop("moved")
        if not now.where("moved").limit(1).count():
            break
    return parts


def _quality(both: DataFrame, loops: DataFrame, labels: DataFrame, doubled: float) -> float:
    """Modularity of labels (node, k, label); ``loops`` (node, w) is weight inside nodes."""
    x, y = labels.select(F.col("node").alias("a"), "label"), labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
    inside = both.join(x, "a").join(y, "b").where("label = other").agg(F.sum("w")).first()[0] or 0.0
    own = loops.agg(F.sum("w")).first()[0] or 0.0
    squares = labels.groupBy("label").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return (inside + 2 * own) / doubled - squares / doubled**2


def communities(edges: DataFrame, least: int = 3) -> DataFrame:
    """(node, cluster, size) of a graph's communities of ``least`` nodes or more; a cluster's name is its first node.

    ``edges`` has a, b and weight (above 0); direction, repeats and loops are
    allowed, null ends are left out.
    """
    given = edges.where("a IS NOT NULL AND b IS NOT NULL AND weight > 0").select("a", "b", F.col("weight").cast("double").alias("w"))
    both = materialize(_both(given), "ways")
    loops = materialize(given.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w")), "loops")
    degree = both.select(F.col("a").alias("node"), "w").unionByName(loops.select("node", (F.col("w") * 2).alias("w"))).groupBy("node").agg(F.sum("w").alias("k"))
    labels = materialize(degree.withColumn("label", F.col("node")), "labels")
    doubled = labels.agg(F.sum("k")).first()[0] or 1.0
    place = labels.select("node", F.col("node").alias("at"))
    kept, best = labels.select("node", F.col("node").alias("cluster")), None
    number, size = 0, labels.count()
    for _ in range(LEVELS):
        quiet = 0
        for _ in range(MOVES):
            now = materialize(_move(both, labels, doubled, number), "labels")
            labels, number = now.drop("moved"), number + 1
            quiet = 0 if now.where("moved").limit(1).count() else quiet + 1
            if quiet == 2:
                break
        worth = _quality(both, loops, labels, doubled)
        if best is not None and worth <= best + 1e-12:
            break
        best = worth
        kept = materialize(place.join(labels.select(F.col("node").alias("at"), "label"), "at").select("node", F.col("label").alias("cluster")), "clusters")
        parts = _refine(both, labels, doubled)
        place = materialize(place.join(parts.select(F.col("node").alias("at"), "part"), "at").select("node", F.col("part").alias("at")), "places")
        x, y = parts.select(F.col("node").alias("a"), F.col("part").alias("pa")), parts.select(F.col("node").alias("b"), F.col("part").alias("pb"))
        merged = both.join(x, "a").join(y, "b").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("w").alias("w"))
        merged = materialize(merged, "ways")
        own = merged.where("a = b").select(F.col("a").alias("node"), (F.col("w") / 2).alias("w")).unionByName(loops.join(parts.select("node", "part"), "node").select(F.col("part").alias("node"), "w"))
        loops = materialize(own.groupBy("node").agg(F.sum("w").alias("w")), "loops")
        both = merged.where("a <> b")
        labels = materialize(parts.groupBy(F.col("part").alias("node")).agg(F.sum("k").alias("k"), F.first("label").alias("label")), "labels")
        before, size = size, labels.count()
        if size == before:
            break
    named = kept.groupBy("cluster").agg(F.min("node").alias("name"), F.count("*").alias("size")).where(F.col("size") >= least)
    return kept.join(named, "cluster").select("node", F.col("name").alias("cluster"), "size")


def titles(edges: DataFrame, assigned: DataFrame, top: int = 3) -> DataFrame:
    """(cluster, size, title): the strongest nodes of every cluster, by weight of their edges, joined by commas."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("strength"))
    first = top_per_group(assigned.join(ends, "node"), "cluster", [F.desc("strength"), F.col("node")], top)
    return first.groupBy("cluster").agg(F.first("size").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "node"))), lambda x: x["node"]), ", ").alias("title"))
