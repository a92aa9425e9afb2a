"""Near-duplicate chunks by MinHash signatures and bands, and what builds on them.

A shingle's base hash is the first 32 bits of its MD5, so signatures can be
recomputed anywhere; the permutations are fixed by a rule.  Equal signatures
collapse to one representative before any join, so a group of copies costs one
row however large it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.text import jaccard, shingles
from lithoframe.operators.components import connected_components
from lithoframe.plans.scratch import materialize, new_path

PRIME = (1 << 31) - 1
PERMUTATIONS, BANDS, ROWS = 64, 16, 4
#: Signatures of one band that one part takes.
CROWD = 1024
#: Documents of a shared chunk that are met in pairs.
SHARERS = 64


def permutation(k: int) -> tuple[int, int]:
    """Multiplier and addend of the k-th permutation."""
    return 2654435761 * (k + 1) % (PRIME - 1) + 1, 40503 * (k + 1) * (k + 1) % PRIME


def base_hash(shingle: Column) -> Column:
    return F.conv(F.substring(F.md5(shingle.cast("binary")), 1, 8), 16, 10).cast("long")


def _signatures(hashes: pd.Series) -> pd.Series:
    a, b = (np.array(x, np.uint64) for x in zip(*map(permutation, range(PERMUTATIONS))))

    def one(h):
        if h is None or not len(h):
            return None
        x = np.asarray(h, np.uint64) % np.uint64(PRIME)
        return ((x[:, None] * a + b) % np.uint64(PRIME)).min(0).astype(np.int64)

    return hashes.map(one)


def _sign_frames(frames):
    for f in frames:
        yield pd.DataFrame({"id": f["id"], "sig": _signatures(f["h"])})


def signatures(df: DataFrame, id_col: str, text: Column, k: int = 5) -> DataFrame:
    """id and sig, the MinHash signature of the word shingles of a text; null without any."""
    hashed = df.select(F.col(id_col).alias("id"), F.transform(shingles(text, k), base_hash).alias("h"))
    return hashed.mapInPandas(_sign_frames, f"id {df.schema[id_col].dataType.simpleString()}, sig array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.lit(float(PERMUTATIONS))


def bands(sig: Column) -> Column:
    """Array of (band, key)."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_join(F.transform(F.slice(sig, b * ROWS + 1, ROWS), lambda x: x.cast("string")), "-").alias("key")))


def keyed_bands(df: DataFrame) -> DataFrame:
    """(band, key, id, sig) for every band of rows (id, sig)."""
    return df.select("id", "sig", F.explode(bands(F.col("sig"))).alias("x")).select("x.band", "x.key", "id", "sig")


def similar_pairs(df: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, similarity) of representatives, a < b; ``df`` has id and sig, one row for each signature.

    The rows of a band that more than `CROWD` signatures share are dealt to parts on
    one side, and sent to all parts on the other.
    """
    keyed = keyed_bands(df)
    crowded = materialize(keyed.groupBy("band", "key").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts")).where("parts > 1"), "crowded")
    parts = keyed.join(crowded, ["band", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = parts.select("band", "key", F.col("id").alias("a"), F.col("sig").alias("s"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    y = parts.select("band", "key", F.col("id").alias("b"), F.col("sig").alias("t"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = x.join(y, ["band", "key", "part"]).where(F.col("a") < F.col("b")).select("a", "b", estimate(F.col("s"), F.col("t")).alias("similarity"))
    return met.where(F.col("similarity") >= least).distinct()


def first_kept(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id`` and ``kept``: in order of id, a row is kept unless an earlier kept row is similar to it.

    Decided in rounds for all rows at once: a row with no open earlier neighbour is
    kept, and its later neighbours are not.  Only what is still open goes on to the
    next round, so most rows take part in one; each round decides the least open row
    at least, so the rounds end.
    """
    path = new_path(nodes.sparkSession, "kept")

    def save(free: DataFrame, number: int) -> DataFrame:
        free.write.parquet(f"{path}/round={number}")
        return nodes.sparkSession.read.schema(free.schema).parquet(f"{path}/round={number}")

    open_, number = pairs.select("a", "b"), 0
    free = save(nodes.select("id").join(pairs.select(F.col("b").alias("id")), "id", "left_anti"), 0)
    while free.limit(1).count():
        a_free = free.select(F.col("id").alias("a"))
        dropped = open_.join(a_free, "a", "left_semi").select(F.col("b").alias("id")).distinct()
        waiting = open_.join(dropped.select(F.col("id").alias("b")), "b", "left_anti")
        now = materialize(waiting.join(dropped.select(F.col("id").alias("a")), "a", "left_anti").select("a", "b"), "open")
        number += 1
        free = save(waiting.select(F.col("b").alias("id")).distinct().join(now.select(F.col("b").alias("id")), "id", "left_anti"), number)
        open_ = now
    kept = nodes.sparkSession.read.schema(free.schema).parquet(*[f"{path}/round={k}" for k in range(number + 1)])
    return nodes.select("id").join(kept.withColumn("kept", F.lit(True)), "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def sign_long(df: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(id, sig): signatures of texts of at least ``least_words`` words, null for others; a table."""
    words = F.size(F.regexp_extract_all(F.lower(text_col), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    long_enough = df.select(F.col(id_col).alias("id"), F.when(words >= least_words, F.col(text_col)).alias("__t"))
    return materialize(signatures(long_enough, "id", F.col("__t")), "signatures")


def near_duplicates(df: DataFrame, *, id_col: str = "id", text_col: str = "text", least_words: int = 20, least: float = 0.8) -> DataFrame:
    """``id`` and ``original``: the earliest kept row most similar to it, or null for kept rows.

    Texts of fewer than ``least_words`` words are never duplicates and never originals.
    """
    signed = sign_long(df, id_col, text_col, least_words)
    reps = materialize(signed.where("sig IS NOT NULL").groupBy("sig").agg(F.min("id").alias("id")).select("id", "sig"), "representatives")
    pairs = materialize(similar_pairs(reps, least), "pairs")
    kept = materialize(first_kept(reps, pairs), "kept")
    best = pairs.join(kept.where("kept").select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("rep")).agg(F.min_by("a", F.struct(-F.col("similarity"), F.col("a"))).alias("orig"))
    of = reps.join(kept, "id").join(best, F.col("id") == F.col("rep"), "left").select("sig", F.col("id").alias("rep"), F.when(F.col("kept"), F.col("id")).otherwise(F.col("orig")).alias("to"))
    return signed.join(of, "sig", "left").select("id", F.when(F.col("to") != F.col("id"), F.col("to")).alias("original"))


def protected_differences(a: Column, b: Column, marks: dict[str, str]) -> Column:
    """Names of the kinds of marks (regular expressions) in which two texts differ as sets."""
    found = lambda t, p: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(f"({p})"), F.lit(1))))
    return F.array_compact(F.array(*[F.when(found(a, p) != found(b, p), F.lit(n)) for n, p in marks.items()]))


def prefilter(jaccard_value: Column, differences: Column, terms: Column, least: float = 0.8, least_terms: int = 3) -> Column:
    """REVIEW_NOT_DROP for a near copy with protected differences, DROP_DUPLICATE, DROP_SPARSE or KEEP."""
    near = F.coalesce(jaccard_value >= least, F.lit(False))
    return F.when(near & (F.size(differences) > 0), "REVIEW_NOT_DROP").when(near, "DROP_DUPLICATE").when(terms < least_terms, "DROP_SPARSE").otherwise("KEEP")


def _sharing(items: DataFrame, needs: DataFrame, crowd: int) -> DataFrame:
    """Links (a, b) of nodes (node, need) that share as many items (node, h) as the lesser need asks for.

    Pairs are made of the nodes that share an item of at most ``crowd`` nodes.  Two
    others share common items only; nodes of the same common items and need are alike
    to these, so one of each kind goes on, with a larger crowd.  All of a kind are
    linked if its items suffice by themselves, or if the one that goes on finds a link:
    then each of them has it.
    """
    counted = materialize(items.join(items.groupBy("h").agg(F.count("*").alias("f")).where("f > 1"), "h"), "counted")
    common = materialize(counted.where(F.col("f") > crowd).groupBy("node").agg(F.array_sort(F.collect_list("h")).alias("hot")).join(needs, "node"), "common")
    side = lambda n: counted.where(F.col("f") <= crowd).select("h", F.col("node").alias(n))
    pairs = side("a").join(side("b"), "h").where("a > b").groupBy("a", "b").agg(F.count("*").alias("n"))
    of = lambda n: needs.select(F.col("node").alias(n), F.col("need").alias(f"need_{n}"))
    met = materialize(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.least("need_a", "need_b") - F.col("n")).alias("missing")), "met")
    sets = lambda n: common.select(F.col("node").alias(n), F.col("hot").alias(f"hot_{n}"))
    more = met.where("missing > 0").join(sets("a"), "a").join(sets("b"), "b").where(F.size(F.array_intersect("hot_a", "hot_b")) >= F.col("missing"))
    links = met.where("missing <= 0").select("a", "b").unionByName(more.select("a", "b"))
    if not common.limit(1).count():
        return links
    kinds = materialize(common.groupBy("hot", "need").agg(F.min("node").alias("first")), "kinds")
    further = materialize(_sharing(kinds.select(F.col("first").alias("node"), F.explode("hot").alias("h")), kinds.select(F.col("first").alias("node"), "need"), 4 * crowd), "links")
    linked = further.select(F.col("a").alias("first")).unionByName(further.select(F.col("b").alias("first"))).distinct().withColumn("linked", F.lit(True))
    alike = common.join(kinds.join(linked, "first", "left"), ["hot", "need"]).where((F.size("hot") >= F.col("need")) | F.col("linked"))
    return links.unionByName(further).unionByName(alike.where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")))


def sharing_links(items: DataFrame, sizes: DataFrame, share: float = 0.3) -> DataFrame:
    """(a, b): links with the components of all pairs of documents that share at least ``share`` of the smaller one's chunks.

    ``items`` (doc_id, h) are the chunks that count, each once for a document, ``sizes``
    (doc_id, chunks) the numbers of all.  A chunk that very many documents have
    makes no pairs of them.
    """
    least = F.greatest(F.ceil(share * F.col("chunks")), F.lit(1))
    fits = lambda n: n / F.col("chunks") >= share
    need = F.when((least > 1) & fits(least - 1), least - 1).when(fits(least), least).otherwise(least + 1)
    return _sharing(items.select(F.col("doc_id").alias("node"), "h"), sizes.select(F.col("doc_id").alias("node"), need.cast("long").alias("need")), SHARERS)


def source_families(copies: DataFrame | None, sizes: DataFrame, others: Sequence[DataFrame] = (), share: float = 0.3) -> DataFrame:
    """``doc_id`` and ``family``: documents joined by shared copies or other links.

    ``copies`` (a, b, n): n chunks of document a are copies of chunks of b;
    ``sizes`` (doc_id, chunks).  Linked when n is at least ``share`` of the
    smaller document.  ``others`` are frames of further links (a, b), such as
    `sharing_links`, which needs no ``copies``.
    """
    x, y = sizes.select(F.col("doc_id").alias("a"), F.col("chunks").alias("na")), sizes.select(F.col("doc_id").alias("b"), F.col("chunks").alias("nb"))
    linked = [o.select("a", "b") for o in others]
    if copies is not None:
        linked.append(copies.join(x, "a").join(y, "b").where(F.col("n") / F.least("na", "nb") >= share).select("a", "b"))
    linked = reduce(DataFrame.unionByName, linked)
    found = connected_components(linked)
    return sizes.select("doc_id").join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id", "left").select("doc_id", F.coalesce("family", "doc_id").alias("family"))


__all__ = ["bands", "estimate", "first_kept", "jaccard", "near_duplicates", "permutation", "prefilter", "protected_differences", "sharing_links", "signatures", "similar_pairs", "source_families"]
