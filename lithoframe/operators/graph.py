"""The graph of facts: links, entities, closures, neighbourhoods, clusters and gaps.

Edges are DataFrames with src, relation and dst; nothing is collected.  Walks
are loops of equi-joins over a frontier of distinct nodes, each round written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.operators.components import connected_components
from lithoframe.plans.scratch import materialize


def canonicalise(facts: DataFrame, names: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Facts with canonical ends: dictionary ``names`` (key, canon) over the raw name.

    ``relations`` (relation, canon_relation, flip) renames relations and swaps the
    ends of inverse ones.  Facts whose ends become equal are dropped.
    """
    a, b = names.select(F.col("key").alias("src"), F.col("canon").alias("__s")), names.select(F.col("key").alias("dst"), F.col("canon").alias("__d"))
    out = facts.join(a, "src", "left").join(b, "dst", "left").withColumn("__s", F.coalesce("__s", "src")).withColumn("__d", F.coalesce("__d", "dst"))
    flip = F.lit(False)
    relation = F.col("relation")
    if relations is not None:
        out = out.join(relations, "relation", "left")
        flip, relation = F.coalesce("flip", F.lit(False)), F.coalesce("canon_relation", "relation")
    rest = [c for c in facts.columns if c not in ("src", "dst", "relation")]
    return out.select(F.when(flip, F.col("__d")).otherwise(F.col("__s")).alias("src"), relation.alias("relation"), F.when(flip, F.col("__s")).otherwise(F.col("__d")).alias("dst"), *rest).where("src <> dst")


def merge_dictionaries(dictionary: DataFrame, automatic: DataFrame) -> DataFrame:
    """(key, canon): the dictionary's entry where it has one, else the automatic one."""
    auto = automatic.select("key", F.col("canon").alias("__auto"))
    return dictionary.join(auto, "key", "full_outer").select("key", F.coalesce("canon", "__auto").alias("canon"))


def entities(facts: DataFrame) -> DataFrame:
    """Every end with its facts, documents and most common kind of relation."""
    both = facts.select(F.col("src").alias("name"), "doc_id", "relation").unionByName(facts.select(F.col("dst").alias("name"), "doc_id", "relation"))
    kinds = both.groupBy("name", "relation").agg(F.count("*").alias("n"))
    kind = kinds.groupBy("name").agg(F.min_by("relation", F.struct(-F.col("n"), F.col("relation"))).alias("relation"))
    return both.groupBy("name").agg(F.count("*").alias("facts"), F.count_distinct("doc_id").alias("docs")).join(kind, "name")


def closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor, depth): every pair that parent links connect, nearest depth; safe on cycles.

    ``edges`` has child and parent.  Every round joins the paths found so far end to
    end, so the rounds grow with the logarithm of the longest chain, and they go on
    until nothing is new; a null end links nothing.
    """
    found, seen = materialize(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "closure"), None
    while True:
        mark = found.agg(F.count("*"), F.sum("depth")).first()
        if mark == seen:
            return found
        seen = mark
        longer = found.alias("x").join(found.alias("y"), F.col("x.ancestor") == F.col("y.child")).select("x.child", "y.ancestor", (F.col("x.depth") + F.col("y.depth")).alias("depth"))
        found = materialize(found.unionByName(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")), "closure")


def subgraph(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(node, level): nodes within ``depth`` steps of ``start`` (column node) in either direction."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("__to")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("__to"))).distinct()
    seen = materialize(start.select("node").distinct().withColumn("level", F.lit(0)), "seen")
    front = seen
    for level in range(1, depth + 1):
        step = both.join(front.select("node"), "node", "left_semi").select(F.col("__to").alias("node")).distinct()
        front = materialize(step.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)), "front")
        seen = seen.unionByName(front)
    return seen


def entity_dataset(facts: DataFrame, inside: DataFrame, structure: str = "part_of") -> DataFrame:
    """Facts that touch a set of names (column name), with direction and other end.

    Links of the structure with both ends inside are not facts about the subject.
    """
    x, y = inside.select(F.col("name").alias("src"), F.lit(True).alias("__s")), inside.select(F.col("name").alias("dst"), F.lit(True).alias("__d"))
    touched = facts.join(x, "src", "left").join(y, "dst", "left").where("__s OR __d")
    within = F.coalesce("__s", F.lit(False)) & F.coalesce("__d", F.lit(False))
    touched = touched.where(~(within & (F.coalesce("rel_type", F.lit("")) == structure)))
    out = F.coalesce("__s", F.lit(False))
    named = touched.select("id", "doc_id", "relation", F.when(out, "→").otherwise("←").alias("direction"), F.when(out, F.col("dst")).otherwise(F.col("src")).alias("other"))
    return named.groupBy("relation", "direction", "other").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("fragments"))


def contains_name(names: DataFrame, key: Column) -> DataFrame:
    """Names whose key holds the other key as whole words."""
    return names.where(F.contains(F.concat(F.lit(" "), F.col("key"), F.lit(" ")), F.concat(F.lit(" "), key, F.lit(" "))))


def chunk_links(facts: DataFrame) -> DataFrame:
    return facts.groupBy("chunk_id").agg(F.count_distinct("src", "relation", "dst").alias("links"), F.min("id").alias("first_id"))


def network(facts: DataFrame, limit: int) -> DataFrame:
    """Typed rows of a network picture: the ``limit`` strongest edges and their nodes."""
    edges = facts.groupBy("src", "dst").agg(F.count_distinct("doc_id").alias("weight")).orderBy(F.desc("weight"), "src", "dst").limit(limit)
    edges = materialize(edges, "edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name"), "weight")
    nodes = ends.groupBy("name").agg(F.sum("weight").alias("weight"))
    return nodes.select(F.lit("node").alias("type"), F.col("name").alias("a"), F.lit(None).cast("string").alias("b"), "weight").unionByName(edges.select(F.lit("edge").alias("type"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight"))


def neighbourhood(facts: DataFrame, name: str, n: int) -> DataFrame:
    """The n neighbours of a name with most documents."""
    near = facts.where((F.col("src") == name) | (F.col("dst") == name)).select(F.when(F.col("src") == name, F.col("dst")).otherwise(F.col("src")).alias("other"), "doc_id")
    return near.groupBy("other").agg(F.count_distinct("doc_id").alias("docs")).orderBy(F.desc("docs"), "other").limit(n)


def gaps(facts: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """Names without facts, and names with at least ``least`` facts that all come from one document."""
    both = facts.select(F.col("src").alias("name"), "doc_id").unionByName(facts.select(F.col("dst").alias("name"), "doc_id"))
    known = both.groupBy("name").agg(F.count("*").alias("facts"), F.count_distinct("doc_id").alias("docs"))
    empty = names.join(known, "name", "left_anti").select("name", F.lit("no_facts").alias("gap"), F.lit(0).cast("long").alias("facts"))
    single = known.where((F.col("facts") >= least) & (F.col("docs") == 1)).select("name", F.lit("one_source").alias("gap"), "facts")
    return empty.unionByName(single)


def question_candidates(facts: DataFrame, per_doc: int) -> DataFrame:
    """One fact for each link, at most ``per_doc`` of a document, best votes first."""
    best = facts.withColumn("__rn", F.row_number().over(Window.partitionBy("src", "relation", "dst").orderBy(F.desc_nulls_last("votes"), "id"))).where("__rn = 1").drop("__rn")
    return best.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("votes"), "id"))).where(F.col("turn") <= per_doc)


def clusters(edges: DataFrame, rounds: int = 8, least: int = 3) -> DataFrame:
    """(node, cluster): weighted label propagation from one label per node, a substitute for modularity clustering.

    Each round a node takes the label with most weight among its neighbours and
    itself, the smaller label winning ties; clusters smaller than ``least`` are
    left out.  ``edges`` has a, b and weight.  Deterministic.
    """
    both = materialize(edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "both")
    labels = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("weight").alias("w"))
        votes = votes.unionByName(labels.withColumn("w", F.lit(0.5)).select("node", "label", F.col("w").cast(dict(votes.dtypes)["w"]).alias("w")))
        best = votes.groupBy("node").agg(F.max_by("label", F.struct("w", F.hash("label"), "label")).alias("label"))
        changed = best.join(labels.withColumnRenamed("label", "__old"), "node").where("label <> __old").limit(1)
        best = materialize(best, "labels")
        done = not changed.count()
        labels = best
        if done:
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return labels.join(sizes, "label").select("node", F.col("label").alias("cluster"), "size")


def modularity(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row with the modularity of a clustering of weighted edges (a, b, weight)."""
    x, y = assigned.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), assigned.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))
    met = edges.join(x, "a", "left").join(y, "b", "left")
    degree = met.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("d"))
    inside = met.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("e"))
    squares = degree.where("c IS NOT NULL").agg(F.sum(F.col("d") * F.col("d")).alias("s"))
    return inside.join(squares, F.lit(True)).select(F.round(F.col("e") / F.col("m") - F.col("s") / (4.0 * F.col("m") * F.col("m")), 6).alias("modularity"))


__all__ = [
    "canonicalise", "chunk_links", "closure", "clusters", "connected_components", "contains_name", "entities", "entity_dataset", "gaps", "merge_dictionaries", "modularity", "neighbourhood", "network", "question_candidates", "subgraph",
]
