"""SimHash near-duplicates by multi-index hashing: within a radius (op8), or of a similarity (pipeline).

The next paragraphs are on `near_duplicates`; `similar_groups` states its own search.

Fingerprint: a text's A-Z lower-cased words make k-word shingles, repeats
included (a shorter text is one shingle); each votes with its XXH64 (seed 42),
and a bit is set when over half the shingles set it.

Search: fingerprints that differ in at most ``radius`` of 64 bits are found by
cutting the bits into segments.  Segment i gets a threshold t_i with
sum(t_i + 1) = radius + 1, so a linked pair differs in at most t_i bits of some
segment i.  Every distinct fingerprint is listed under its own segment values
and looks up the values in the Hamming ball of t_i bits around them (only the
smaller ones: of two values one is smaller); every match is verified over all
64 bits.  The number of segments follows the number of distinct fingerprints,
so that a segment has about as many values as there are fingerprints.

Exact copies collapse to one distinct fingerprint before the search.  A segment
value that many distinct fingerprints share is not joined: its members are dealt
into blocks, each pair of blocks is searched in one task, and only a spanning
forest of the verified links leaves the task.  So the work is spread, memory is
bounded, no link between components is lost and no group is emitted as pairs.

Edge cases: null and empty texts have fingerprint zero and link like any other;
repeated rows each give a row; null ids link but are never a component's id
unless all its ids are null; texts of any length are read whole; ties do not
arise (of rows alike any stands for them); an empty table gives an empty table;
other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm.common import ascii_lower, materialize, small_batches, table, text_or_empty, vote_columns, vote_names, voted_bits, words
from lithoframe.operators.components import connected_components

#: Listings of a segment value up to which it is joined directly, and that many times the mean.
LIGHT, LIGHT_MEAN = 48, 8
#: Members of one block of a larger segment value.
BLOCK = 4096
#: A comparison's cost as a share of a listing's.
MATCH_COST = 0.05
#: Of `similar_groups`: share of bits in which similar sets are taken to differ, chance that
#: such sets share no segment, and bits of the first words in which candidates differ at most.
APART, MISSED, NEAR_WORDS, NEAR_BITS = 1 / 6, 2e-5, 3, 58
#: Codes in one block of a segment value, and those that a value has on average.
BLOCK_CODES, MEAN_CODES = 4096, 1024
#: Shingles whose votes a 16-bit counter holds.
COUNTED = 65535
#: Candidates per member up to which a block's are listed as pairs; members, and
#: hashes of their sets, in one block of a value with more.
FEW, BLOCK_SETS, BLOCK_HASHES = 1, 512, 2_000_000


def shingle_hashes(w: Column, k: int) -> Column:
    """XXH64 (seed 42) of every run of k words, or of all words when there are fewer."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)])))
    return F.when(F.size(w) >= k, runs).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))


def simhash_fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id_col`` and ``fp`` (64 bits as a long) of every row."""
    rows = df.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"), words(ascii_lower(text_or_empty(text_col))).alias("__w"))
    terms = rows.select("__id", "__row", F.explode_outer(shingle_hashes(F.col("__w"), shingle)).alias("__h"))
    votes = terms.groupBy("__id", "__row").agg(*vote_columns(F.col("__h")), F.count("__h").alias("__n"))
    return votes.select(F.col("__id").alias(id_col), voted_bits(F.array(F.array(*vote_names())), F.col("__n")).alias("fp"))


def _plan(count: int, radius: int, bits: int) -> list[tuple[int, int, int]]:
    out, shift = [], 0
    for i in range(count):
        width = (bits - shift) // (count - i)
        out.append((shift, width, (radius + 1) // count + (i < (radius + 1) % count) - 1))
        shift += width
    return [s for s in out if s[2] >= 0]


def listings(plan: list[tuple[int, int, int]]) -> float:
    """Mean number of segment values that a fingerprint is listed under or looks up."""
    return sum(1 + (_ball(width, near) - 1) / 2 for _, width, near in plan)


def _ball(width: int, near: int) -> int:
    return sum(math.comb(width, r) for r in range(near + 1))


def per_value(plan: list[tuple[int, int, int]], distinct: int) -> float:
    """Mean number of listings of a segment value, in the fullest segment."""
    return max(distinct * (1 + (_ball(width, near) - 1) / 2) / 2**width for _, width, near in plan)


def segments(distinct: int, radius: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(shift, width, threshold) of each segment; every linked pair meets one threshold.

    Their number makes least work for ``distinct`` fingerprints: a listing is
    shuffled and sorted, a match of two of them only compared, at about
    `MATCH_COST` of that.
    """

    def cost(plan: list[tuple[int, int, int]]) -> float:
        matches = sum(distinct * (1 + (_ball(width, near) - 1) / 2) / 2**width for _, width, near in plan)
        return listings(plan) + MATCH_COST * matches

    return min((_plan(count, radius, bits) for count in range(min(2, radius + 1), radius + 2)), key=cost)


def _entry(segment: int, key: Column, listed: bool) -> Column:
    return F.struct(F.lit(segment).alias("seg"), key.alias("key"), F.lit(listed).alias("listed"))


def _nearby(segment: int, own: Column, masks: list[int]) -> Column:
    """Entries of the values that differ from ``own`` by a mask and are smaller."""
    flipped = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: own.bitwiseXOR(m))
    return F.transform(F.filter(flipped, lambda x: x < own), lambda x: _entry(segment, x, False))


def _keys(fp: Column, plan: list[tuple[int, int, int]]) -> Column:
    """Array of (seg, key, listed): a row under its own values, and looking up smaller ones nearby."""
    parts = []
    for i, (shift, width, near) in enumerate(plan):
        own = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        parts.append(F.array(_entry(i, own, True)))
        masks = [sum(1 << b for b in c) for r in range(1, near + 1) for c in combinations(range(width), r)]
        if masks:
            parts.append(_nearby(i, own, masks))
    return F.concat(*parts)


def _forest(group: pa.Table, radius: int) -> pa.Table:
    """A spanning forest of the links among a block pair's fingerprints."""
    rest = np.unique(group.column("fp").to_numpy()).view(np.uint64)
    out: list[tuple[np.ndarray, np.uint64]] = []
    while len(rest):
        todo, rest = [rest[-1]], rest[:-1]
        while todo and len(rest):
            one = todo.pop()
            near = np.bitwise_count(rest ^ one) <= radius
            if near.any():
                out.append((rest[near], one))
                todo.extend(rest[near])
                rest = rest[~near]
    a = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.uint64)
    b = np.repeat(np.array([y for _, y in out], np.uint64), [len(x) for x, _ in out])
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(distinct: DataFrame, radius: int = 4, plan: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Verified links (a, b) among distinct fingerprints ``fp``, a materialized table.

    All links of segment values with few members; a spanning forest of those of
    values with many.  Any ``plan`` of segments gives the same components.
    """
    n = distinct.count()
    plan = plan or segments(n, radius)
    light_size = max(LIGHT, int(LIGHT_MEAN * per_value(plan, n)))
    rows = distinct.select("fp", F.explode(_keys(F.col("fp"), plan)).alias("k")).select("fp", "k.seg", "k.key", "k.listed")
    sizes = rows.groupBy("seg", "key").agg(F.count(F.when(F.col("listed"), 1)).alias("n0"), F.count("*").alias("n"))
    heavy = materialize(sizes.where((F.col("n0") > 0) & (F.col("n") > light_size)).select("seg", "key", "n"), "heavy")
    light = rows.join(heavy, ["seg", "key"], "left_anti")
    own, other = light.where("listed").alias("x"), light.alias("y")
    apart = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    met = own.join(other, (F.col("x.seg") == F.col("y.seg")) & (F.col("x.key") == F.col("y.key")) & (~F.col("y.listed") | (F.col("x.fp") < F.col("y.fp"))) & (apart <= radius))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.join(heavy, ["seg", "key"]).withColumn("__b", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("__o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pairs = dealt.select("seg", "key", F.least("__b", "__o").alias("lo"), F.greatest("__b", "__o").alias("hi"), "fp")
    found = pairs.groupBy("seg", "key", "lo", "hi").applyInArrow(lambda t: _forest(t, radius), "a long, b long")
    return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).unionByName(found)


def _named(nodes: DataFrame, links_: DataFrame) -> DataFrame:
    """node, component_id (the smallest id of its component) and stands (whether it is the first node with that id) of ``nodes`` (node, least)."""
    parts = connected_components(links_).select("node", F.col("component").alias("part"))
    labelled = materialize(nodes.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "labelled")
    first = F.min(F.when(F.col("least").isNotNull(), F.struct("least", "node")))
    # a table of its own, so that the join can split a large component's rows
    firsts = materialize(labelled.groupBy("part").agg(first.alias("first")), "firsts")
    return labelled.join(firsts, "part").select("node", F.col("first.least").alias("component_id"), F.coalesce(F.col("first.node") == F.col("node"), F.lit(False)).alias("stands"))


def _simhash_groups(df: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """``id_col``, node (the fingerprint), component_id and stands of every row."""
    prints = materialize(simhash_fingerprints(df, id_col=id_col, text_col=text_col, shingle=shingle).withColumnRenamed("fp", "node"), "prints")
    distinct = materialize(prints.groupBy("node").agg(F.min(id_col).alias("least")), "distinct")
    return prints.join(_named(distinct, links(distinct.select(F.col("node").alias("fp")), radius)), "node")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``id_col``, fingerprint (hex) and component_id, the smallest id that links reach."""
    return _simhash_groups(df, id_col, text_col, shingle, radius).select(id_col, F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def _keep_least(df: DataFrame, grouped: DataFrame, id_col: str, with_node: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``df`` that stand for their component in ``grouped``, one of each id and node; ``with_node`` adds ``__keep_node``."""
    groups = grouped.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__keep_id"), F.col("node").alias("__of"), ((F.col(id_col) == F.col("component_id")) & F.col("stands")).alias("__stands"))
    groups = materialize(groups, "groups")
    often = materialize(groups.groupBy("__keep_id").count().where("count > 1").select("__keep_id"), "often")
    chosen = groups.where("__stands").select("__keep_id", "__of").distinct()
    same_id = F.col(id_col) == F.col("__keep_id")
    kept = df.join(chosen.join(often, "__keep_id", "left_anti").select("__keep_id").hint("merge"), same_id, "left_semi").select(df.columns)
    if often.limit(1).count():
        rows = with_node(df.join(often.hint("merge"), same_id, "left_semi"))
        rows = rows.join(chosen.hint("merge"), same_id & (F.col("__keep_node") == F.col("__of")), "left_semi")
        kept = kept.unionByName(rows.dropDuplicates([id_col, "__keep_node"]).select(df.columns))
    return kept.unionByName(df.where(F.col(id_col).isNull()))


def keep_one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``df``, all columns, that stand for their component: one row, of its smallest id.

    Rows that share an id are told apart by their text, so each component keeps a
    row of its own; of rows equal in id and text any one stays.  Rows with a null
    id all stay.  The ids to keep grow with the table, so the join is a sort-merge
    join at every size.
    """

    def with_node(rows: DataFrame) -> DataFrame:
        numbered = materialize(rows.withColumn("__keep_row", F.monotonically_increasing_id()), "repeated")
        prints = simhash_fingerprints(numbered, id_col="__keep_row", text_col=text_col, shingle=shingle).select("__keep_row", F.col("fp").alias("__keep_node"))
        return numbered.join(prints, "__keep_row")

    return _keep_least(df, _simhash_groups(df, id_col, text_col, shingle, radius), id_col, with_node)


def _shingle_sets(df: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``df`` with ``__key``, which equal sets of shingles share, and ``__set``, the sorted set."""
    w = df.withColumn("__w", words(ascii_lower(text_or_empty(text_col))))
    return w.withColumn("__set", F.array_sort(F.array_distinct(shingle_hashes(F.col("__w"), shingle)))).withColumn("__key", F.xxhash64("__set")).drop("__w")


def code_segments(rows: int) -> tuple[int, int, int]:
    """Bits of a segment, number of segments and 64-bit words of a code, for so many rows.

    A segment value has about `MEAN_CODES` members, and two sets that differ in a
    share `APART` of the bits agree in no segment with a chance of `MISSED` at most.
    """
    width = min(max(4, int(math.log2(max(rows, 1) / MEAN_CODES))), 32) if rows > MEAN_CODES else 4
    count = math.ceil(math.log(MISSED) / math.log1p(-((1 - APART) ** width)))
    return width, count, max(NEAR_WORDS, math.ceil(count / (64 // width)))


def _word_votes(h: np.ndarray, starts: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 64 bits that over half of each set's hashes set; ``starts`` cut ``h`` into runs, ``first`` the runs into sets."""
    ones, low, out = np.uint64(0x0001000100010001), np.uint64(0xFFFF), np.zeros(len(size), np.uint64)
    for bit in range(16):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & ones, starts)
        for lane in range(0, 64, 16):
            votes = np.add.reduceat((lanes >> np.uint64(lane)) & low, first)
            out |= (2 * votes > size).astype(np.uint64) << np.uint64(bit + lane)
    return out


def _set_codes(batches: Iterable[pa.RecordBatch], words_: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """The SimHash code of each shingle set, ``words_`` words of it; none of a set too small to be similar to another."""
    factors = np.random.default_rng(11).integers(0, 2**63, (words_, 2), np.uint64) * np.uint64(2) + np.uint64(1)
    for t in batches:
        sets = t.column("__set")
        bounds = sets.offsets.to_numpy().astype(np.int64)
        values = sets.values.to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.diff(bounds)
        coded = (sizes > 0) & (sizes >= similarity * (sizes + 1))
        codes = np.zeros((int(coded.sum()), words_), np.uint64)
        if len(codes):
            values, size = values[bounds[0] : bounds[-1]][np.repeat(coded, sizes)], sizes[coded]
            runs = -(-size // COUNTED)
            first = np.cumsum(runs) - runs
            starts = np.repeat(np.cumsum(size) - size, runs) + (np.arange(runs.sum()) - np.repeat(first, runs)) * COUNTED
            for k, (one, two) in enumerate(factors):
                h = values * one
                h = (h ^ (h >> np.uint64(32))) * two
                codes[:, k] = _word_votes(h ^ (h >> np.uint64(29)), starts, first, size)
        ends = pa.array(np.r_[0, np.cumsum(coded * words_)].astype(np.int32))
        yield pa.RecordBatch.from_arrays([t.column("id"), t.column("__key"), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(codes.ravel().view(np.int64)))], ["id", "key", "size", "code"])


def _codes_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sizes and codes of a group's rows."""
    code = t.column("code").combine_chunks()
    flat = code.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return t.column("key").to_numpy(), t.column("size").to_numpy().astype(np.int64), flat.reshape(t.num_rows, -1)


def _close(code: np.ndarray, size: np.ndarray, similarity: float, rows: slice, columns: slice) -> np.ndarray:
    """Which ``rows`` and ``columns`` differ in few bits of the first words and have sizes that allow the similarity."""
    apart = sum(np.bitwise_count(code[rows, k, None] ^ code[None, columns, k]) for k in range(NEAR_WORDS))
    a, b = size[rows, None], size[None, columns]
    return (apart <= NEAR_BITS) & (np.minimum(a, b) >= similarity * np.maximum(a, b))


def _close_stars(t: pa.Table, similarity: float, step: int = 256) -> pa.Table:
    """Each code of a block with a close one of smallest key that is not itself in another's star."""
    t = t.sort_by("key")
    keys, size, code = _codes_of(t)
    free, out = np.ones(len(keys), bool), []
    for at in range(0, len(keys), step):
        close = np.triu(_close(code, size, similarity, slice(at, at + step), slice(at, None)), 1)
        for k in np.flatnonzero(close.any(axis=1)):
            if free[at + k]:
                near = at + np.flatnonzero(close[k] & free[at:])
                free[near] = False
                out.append((keys[near], keys[at + k]))
    a = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.int64)
    b = np.repeat(np.array([y for _, y in out], np.int64), [len(x) for x, _ in out])
    return pa.table({"a": a, "b": b})


def _close_across(key: tuple, t: pa.Table, width: int, similarity: float, step: int = 256) -> pa.Table:
    """A block pair's close codes of different components that agree in no earlier segment: as pairs (a, b), or as members (a) if they are many."""
    seg, lo, hi = key[0].as_py(), key[2].as_py(), key[3].as_py()
    keys, size, code = _codes_of(t)
    part, block = t.column("part").to_numpy(), t.column("__b").to_numpy()
    word, low = 64 // width, np.uint64((1 << width) - 1)
    pairs, count, members = [], 0, np.zeros(len(keys), bool)
    for at in range(0, len(keys), step):
        rows = slice(at, at + step)
        close = np.triu(_close(code, size, similarity, rows, slice(at, None)), 1) & (part[rows, None] != part[None, at:])
        if lo != hi:
            close &= block[rows, None] != block[None, at:]
        i, j = np.nonzero(close)
        i, j = i + at, j + at
        for k in range(seg):
            new = (((code[i, k // word] ^ code[j, k // word]) >> np.uint64(k % word * width)) & low) != 0
            i, j = i[new], j[new]
        members[i] = members[j] = True
        count += len(i)
        if count <= FEW * len(keys):
            pairs.append((keys[i], keys[j]))
    if count > FEW * len(keys):
        a, b = keys[members], pa.nulls(int(members.sum()), pa.int64())
    else:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        a, b = np.minimum(a, b), pa.array(np.maximum(a, b))
    return pa.table({"seg": pa.array(np.full(len(a), seg, np.int32)), "value": pa.array(np.full(len(a), key[1].as_py(), np.int64)), "a": pa.array(a), "b": b})


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of keys of ``sets`` whose exact Jaccard similarity is at least ``similarity``."""
    x, y = sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), sets.select(F.col("key").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(x, "a").join(y, "b").where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _similar_forest(t: pa.Table, similarity: float, columns: int = 8192) -> pa.Table:
    """A spanning forest of the links among a block pair's sets of different components, from their exact common counts."""
    t = t.combine_chunks().to_batches()[0]
    parts, which = np.unique(t.column("part").to_numpy(), return_inverse=True)
    # pairs within the largest component need no count
    lesser = np.flatnonzero(which != np.bincount(which).argmax())
    keys, sets = t.column("key").to_numpy(), t.column("s")
    bounds = sets.offsets.to_numpy().astype(np.int64)
    values, size = sets.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], np.diff(bounds)
    owner = np.repeat(np.arange(len(keys)), size)
    distinct, place, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    at = (np.cumsum(shared) - 1)[place]
    inside = shared[place]
    at, owner = at[inside], owner[inside]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((len(lesser), len(keys)), np.float32)
    for first in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(at, [first, first + columns])
        x = np.zeros((len(keys), columns), np.float32)
        x[owner[a:b], at[a:b] - first] = 1
        common += x[lesser] @ x.T
    linked = np.zeros((len(keys), len(keys)), bool)
    linked[lesser] = common >= similarity * (size[lesser, None] + size[None] - common.astype(np.float64))
    linked |= linked.T
    rest, out = np.ones(len(keys), bool), []
    for start in range(len(keys)):
        todo = [start] if rest[start] else []
        rest[start] = False
        while todo:
            one = todo.pop()
            near = np.flatnonzero(linked[one] & rest)
            rest[near] = False
            todo.extend(near)
            out.extend((keys[k], keys[one]) for k in near)
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _by_segment(codes: DataFrame, width: int, count: int, code: Column, *carried: str) -> DataFrame:
    """``codes`` once for each segment and each pair (lo, hi) of blocks of that segment's value that __b, the code's own, is in."""
    word = 64 // width
    values = F.array(*[F.shiftrightunsigned(F.get("code", F.lit(k // word)), k % word * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(count)])
    sizes = codes.select(F.posexplode(values).alias("seg", "value")).groupBy("seg", "value").count()
    heavy = materialize(sizes.where(F.col("count") > BLOCK_CODES).select("seg", "value", F.ceil(F.col("count") / BLOCK_CODES).cast("int").alias("n")), "heavy")
    listed = codes.select("key", "size", *carried, code.alias("code"), F.posexplode(values).alias("seg", "value"))
    dealt = listed.join(heavy, ["seg", "value"], "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("__b", F.pmod(F.xxhash64("key", "seg"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return dealt.select("seg", "value", F.least("__b", "__o").alias("lo"), F.greatest("__b", "__o").alias("hi"), "__b", "key", "size", *carried, "code")


def _similar_links(df: DataFrame, rows: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, width: int, count: int) -> DataFrame:
    """Links (a, b) that join up all keys of ``rows`` (id, key, size, code) whose sets are similar and share a segment."""
    codes = materialize(rows.where(F.size("code") > 0).groupBy("key").agg(F.first("size").alias("size"), F.first("code").alias("code")), "codes")
    listed = _by_segment(codes, width, count, F.slice("code", 1, NEAR_WORDS)).drop("__b")
    stars = listed.groupBy("seg", "value", "lo", "hi").applyInArrow(lambda t: _close_stars(t.select(["key", "size", "code"]), similarity), "a long, b long")
    stars = materialize(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "close")
    # a code in no star has no close one
    met = materialize(stars.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "met")
    # sets again, only of documents that may have similar ones: one document a key
    one = rows.join(met, "key", "left_semi").groupBy("key").agg(F.min("id").alias("__of")).where("__of is not null").select("__of").distinct()
    some = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    some = some.join(one, F.col("__id") == F.col("__of"), "left_semi").unionByName(some.where(F.col("__id").isNull()))
    sets = _shingle_sets(some, "__t", shingle).select(F.col("__key").alias("key"), F.col("__set").alias("s")).join(met, "key", "left_semi")
    sets = materialize(sets.groupBy("key").agg(F.first("s").alias("s")), "sets")
    near = materialize(_similar(stars, sets, similarity), "near")
    parts = connected_components(near).select(F.col("node").alias("key"), F.col("component").alias("part"))
    known = materialize(codes.join(met, "key", "left_semi").join(parts, "key", "left").withColumn("part", F.coalesce("part", "key")), "known")
    dealt = _by_segment(known, width, count, F.col("code"), "part")
    across = dealt.groupBy("seg", "value", "lo", "hi").applyInArrow(lambda key, t: _close_across(key, t, width, similarity), "seg int, value long, a long, b long")
    across = materialize(across, "across")
    rest = across.where("b is not null").select("a", "b").join(stars, ["a", "b"], "left_anti")
    many = across.where("b is null").select("seg", "value", F.col("a").alias("key")).distinct().join(known.select("key", "size", "part"), "key")
    many = materialize(many, "many")
    loads = many.groupBy("seg", "value").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("hashes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("hashes") / BLOCK_HASHES)).cast("int")
    split = many.join(loads, ["seg", "value"]).withColumn("__b", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("__o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    split = split.select("seg", "value", "key", "part", F.least("__b", "__o").alias("lo"), F.greatest("__b", "__o").alias("hi")).join(sets, "key")
    found = split.groupBy("seg", "value", "lo", "hi").applyInArrow(lambda t: _similar_forest(t.select(["key", "s", "part"]), similarity), "a long, b long")
    return near.unionByName(_similar(rest, sets, similarity)).unionByName(found)


def _similar_groups(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    width, count, words_ = code_segments(df.count())
    sets = small_batches(_shingle_sets(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t")), "__t", shingle).select("id", "__key", "__set"))
    kind = df.schema[id_col].dataType.simpleString()
    rows = materialize(sets.mapInArrow(lambda batches: _set_codes(batches, words_, similarity), f"id {kind}, key long, size int, code array<long>"), "codes_of_rows")
    nodes = rows.groupBy("key").agg(F.min("id").alias("least")).withColumnRenamed("key", "node")
    named = _named(nodes, _similar_links(df, rows, id_col, text_col, shingle, similarity, width, count))
    return rows.select(F.col("id").alias(id_col), F.col("key").alias("node")).join(named, "node")


def similar_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id_col`` and component_id, the smallest id that links of Jaccard similarity ``similarity`` reach.

    SimHash codes of the shingle sets, searched by multi-index hashing.  Sets of
    similarity 0.8 differ in about 15 % of a code's bits, 10 of 64: Hamming balls
    of such a radius have thousands of values a segment.  So the code is longer
    and cut into so many short segments that similar sets agree wholly in one
    (`code_segments`); codes that share a segment's value are compared in blocks,
    over the first 192 bits, and each candidate is verified on the exact sets.
    (Unlike codes differ in 58 of 192 bits or fewer with a chance of 2e-8; over
    128 bits, with a radius of 40, it is 1e-5, and most of the sets that are read
    for verification would be those of unlike codes.)
    First every code is compared with one close to it; then all close codes that
    are still in different components, each pair in the first segment it agrees
    in: as pairs where these are no more than the block's codes, else as the codes
    in them, in blocks whose tasks count common shingles as a matrix product and
    send a spanning forest only.  No candidate is lost, no large group is emitted
    as pairs, and no block sends more rows than it has codes.

    A pair of similarity 0.8 is missed with probability 2e-5 at most, by segments
    and radius together; sets of four and five shingles, which differ in 3 of 16
    bits, with 2e-4 (3e-4 at 500,000 documents, 5e-4 at 12,000,000).
    """
    return _similar_groups(df, id_col, text_col, shingle, similarity).select(id_col, "component_id")


def keep_one_of_similar(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """As `keep_one_of_each`, with the groups of `similar_groups`; rows of one id are told apart by their shingle sets."""

    def with_node(rows: DataFrame) -> DataFrame:
        keyed = _shingle_sets(rows.select("*", F.col(text_col).alias("__keep_text")), "__keep_text", shingle)
        return keyed.withColumn("__keep_node", F.col("__key"))

    return _keep_least(df, _similar_groups(df, id_col, text_col, shingle, similarity), id_col, with_node)


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
