"""Exact cosine join of sparse vectors, without all pairs.

Dimensions are ordered from the rarest on.  If two vectors reach the least
similarity, then so does the norm of either on what they share.  Hence their l
first shared dimensions lie in a prefix of each: beyond it a vector's mass,
together with its l - 1 largest squares, is too small.  Rows meet in buckets of l
dimensions of their prefixes, and a pair is given in the bucket of its l first shared
ones only, so it is never lost and never repeated.  What two rows can share there is
the bucket's dimensions and those after them: the product of these masses must reach
the square of the least similarity, so a bucket's rows are sorted by their mass and each meets
the first of them only.  Longer combinations make
smaller buckets and more of them, so l follows the number of rows; a row whose few
dimensions allow a smaller l only meets all others by that.

A bucket of more than `CROWD` rows is split: each row is dealt to one of its parts,
where it meets all rows of the bucket.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.operators.vector_index import unit_rows
from lithoframe.plans.scratch import materialize

#: Rows of a bucket that one part takes, rows of one that are met without a matrix product, and most buckets of a row.
CROWD, SMALL, MOST = 2048, 48, 2000
#: Rounding that no pair may be lost by.
SLACK = 2e-6


def plan_level(rows: int, width: int) -> int:
    """Dimensions that make a bucket; as many as a long can name."""
    level = 1 + sum(rows > n for n in (2_000, 600_000, 4_000_000))
    return max(1, min(level, int(60 / math.log2(max(width, 2)))))


def prefixes(squares: np.ndarray, size: np.ndarray, least: float, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows' squares in order of rarity: the prefix of each level from 1 on (0: not possible), the row's own level, and the fewest shared dimensions."""
    bound = (least - SLACK) ** 2
    top = np.zeros((len(squares), squares.shape[1] + 1))
    top[:, 1:] = np.cumsum(-np.sort(-squares, axis=1), axis=1)
    rest = np.ones_like(top)
    rest[:, 1:] = 1 - np.cumsum(squares, axis=1)
    need = np.minimum((top < bound).sum(1), size)
    lengths = np.zeros((len(squares), level), np.int64)
    own = np.ones(len(squares), np.int64)
    for e in range(1, level + 1):
        largest = top[:, min(e - 1, squares.shape[1])]
        possible = largest < bound - SLACK
        p = np.minimum((rest + largest[:, None] >= bound).sum(1), size)
        lengths[:, e - 1] = np.where(possible, p, 0)
        many = np.array([math.comb(int(n), e) for n in p]) if e > 1 else np.zeros(len(p))
        own[possible & (many <= MOST) & (own == e - 1)] = e
    return lengths, own, need


def _keyed(least: float, level: int, order: list[int], whole: bool, levels: tuple[int, ...], blobs: bool):
    """Rows (key, mass, n, blob) of rows (n, v); without ``blobs`` only keys, or the rows' own levels if there are no ``levels``."""
    width = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1024):
                part = b.slice(first, 1024)
                x, good = unit_rows(part.column(1), width, False)
                x, n = x[good][:, order], part.column(0).to_numpy()[good]
                if not len(x):
                    continue
                size = np.count_nonzero(x, axis=1)
                ranks = np.argsort(x == 0, axis=1, kind="stable")[:, : size.max()]
                values = np.take_along_axis(x, ranks, 1)
                squares = values**2 / (values**2).sum(1, keepdims=True)
                after = 1 - np.cumsum(squares, axis=1)
                lengths, own, need = prefixes(squares, size, least, level)
                if not levels:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(own))], ["own"])
                    continue
                keys, rows, masses = [], [], []
                for e in levels:
                    for p in np.unique(lengths[own >= e, e - 1]).tolist():
                        at = np.flatnonzero((own >= e) & (lengths[:, e - 1] == p))
                        combos = np.array(list(itertools.combinations(range(p), e)), np.int64).reshape(-1, e)
                        key, mass = np.zeros((len(at), len(combos)), np.int64), after[at][:, combos[:, -1]]
                        for j in range(e):
                            key = key * width + ranks[at][:, combos[:, j]]
                            mass = mass + squares[at][:, combos[:, j]]
                        enough = mass >= (least - SLACK) ** 2
                        keys.append((key * 8 + e)[enough])
                        masses.append(mass[enough])
                        rows.append(np.broadcast_to(at[:, None], key.shape)[enough])
                key, row, mass = np.concatenate(keys), np.concatenate(rows), np.concatenate(masses)
                if not blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])
                    continue
                names, kind = ranks.astype("u1" if width <= 256 else "<u2"), np.int8 if whole else "<f8"
                blob = [np.array([min(c, 65535)], "<u2").tobytes() + bytes([o]) + names[k, :s].tobytes() + values[k, :s].astype(kind).tobytes() for k, (c, o, s) in enumerate(zip(need.tolist(), own.tolist(), size.tolist()))]
                for cut in range(0, len(key), 16_384):
                    r = row[cut : cut + 16_384]
                    yield pa.RecordBatch.from_arrays([pa.array(key[cut : cut + 16_384]), pa.array(mass[cut : cut + 16_384]), pa.array(n[r]), pa.array(blob, pa.binary()).take(pa.array(r))], ["key", "mass", "n", "blob"])

    return run


class _Rows:
    """Rows of whole buckets, sorted by bucket and falling mass; of their vectors bit masks, and matrices of those that are asked for."""

    def __init__(self, t: pa.Table, width: int, whole: bool):
        self.key, self.n, self.part, self.home, self.mass = (t[c].to_numpy() for c in ("key", "n", "part", "home", "mass"))
        self.width, self.whole, self.name = width, whole, 1 if width <= 256 else 2
        blob = pa.concat_arrays(t["blob"].chunks)
        self.flat = np.frombuffer(blob.buffers()[2], np.uint8)
        ends = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
        self.start, self.size = ends[:-1], (np.diff(ends) - 3) // (self.name + (1 if whole else 8))
        self.need, self.own = self.flat[self.start].astype(np.int64) + 256 * self.flat[self.start + 1].astype(np.int64), self.flat[self.start + 2].astype(np.int64)
        new = np.r_[True, (self.key[1:] != self.key[:-1]) | (self.part[1:] != self.part[:-1])]
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.r_[self.first, len(new)])
        self.group = np.cumsum(new) - 1

    def _ranks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dimensions of the rows one after the other, each one's row, and its place in the row."""
        size = self.size[rows]
        row = np.repeat(np.arange(len(rows)), size)
        k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(self.start[rows] + 3, size) + k * self.name
        return self.flat[at].astype(np.int64) + (256 * self.flat[at + 1].astype(np.int64) if self.name == 2 else 0), row, k

    def masks(self, rows: np.ndarray) -> np.ndarray:
        """Words of 64 bits, one bit for each dimension; every row has a dimension."""
        rank, _, _ = self._ranks(rows)
        first = np.cumsum(self.size[rows]) - self.size[rows]
        bit, word = np.uint64(1) << (rank & 63).astype(np.uint64), rank >> 6
        return np.stack([np.bitwise_or.reduceat(np.where(word == w, bit, np.uint64(0)), first) for w in range(-(-self.width // 64))], axis=1)

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        rank, row, k = self._ranks(rows)
        value = 1 if self.whole else 8
        at = np.repeat(self.start[rows] + 3 + self.size[rows] * self.name, self.size[rows]) + k * value
        x = np.zeros((len(rows), self.width))
        x[row, rank] = self.flat[at].view(np.int8) if self.whole else self.flat[at[:, None] + np.arange(8)].view("<f8").ravel()
        return x

    def pairs(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that may reach ``least``, the row of more mass first."""
        bound = (least - SLACK) ** 2
        rows = np.flatnonzero((self.count[self.group] <= SMALL) & (self.count[self.group] > 1))
        if len(rows):
            mask, place = self.masks(rows), np.arange(len(rows))
            group, need, mass = self.group[rows], self.need[rows], self.mass[rows]
            for shift in range(1, SMALL):
                place = place[place + shift < len(rows)]
                place = place[group[place] == group[place + shift]]
                if not len(place):
                    break
                shared = np.bitwise_count(mask[place] & mask[place + shift]).sum(1)
                far = place[(shared >= np.maximum(need[place], need[place + shift])) & (mass[place] * mass[place + shift] >= bound)]
                yield rows[far], rows[far + shift]
        for a, m in zip(self.first[self.count > SMALL].tolist(), self.count[self.count > SMALL].tolist()):
            x = self.matrix(np.arange(a, a + m))
            x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
            mine, falling = np.flatnonzero(self.home[a : a + m] == self.part[a : a + m]), -self.mass[a : a + m]
            for cut in range(0, len(mine), 128):
                i = mine[cut : cut + 128]
                y = slice(int(i[0]), int(np.searchsorted(falling, bound / falling[i[0]], "right")))
                r, c = np.nonzero(x[i] @ x[y].T >= np.float32(least - 1e-4))
                i, j = i[r] + a, c + y.start + a
                keep = i < j
                yield i[keep], j[keep]

    def found(self, least: float) -> Iterator[pa.RecordBatch]:
        for i, j in self.pairs(least):
            mine = (self.home[i] == self.part[i]) & (np.minimum(self.own[i], self.own[j]) == self.key[i] & 7)
            i, j = i[mine], j[mine]
            for cut in range(0, len(i), 4096):
                yield from self._checked(i[cut : cut + 4096], j[cut : cut + 4096], least)

    def _checked(self, i: np.ndarray, j: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
        """The pairs of ``least`` or more whose first shared dimensions are those of their bucket."""
        x, y, e = self.matrix(i), self.matrix(j), self.key[i] & 7
        norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
        s = np.round(np.einsum("ij,ij->i", x, y) / norms, 6)
        near = s >= least
        both = (x[near] != 0) & (y[near] != 0)
        i, j, e, s = i[near], j[near], e[near], s[near]
        key = np.zeros(len(i), np.int64)
        for k in range(int(e.max(initial=0))):
            at = both.argmax(1)
            key = np.where(k < e, key * self.width + at, key)
            both[np.arange(len(i)), at] = False
        own = key * 8 + e == self.key[i]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array(self.n[i[own]]), pa.array(self.n[j[own]]), pa.array(s[own])], ["a", "b", "similarity"])


def _meet(least: float, width: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                rows += b.num_rows
                if rows < 16_384 or held[0]["key"][0] == b["key"][b.num_rows - 1] and held[0]["part"][0] == b["part"][b.num_rows - 1]:
                    continue
            if not rows:
                continue
            t = pa.Table.from_batches(held)
            key, part = t["key"].to_numpy(), t["part"].to_numpy()
            cut = len(key) if b is None else int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1
            yield from _Rows(t.slice(0, cut), width, whole).found(least)
            held, rows = t.slice(cut).to_batches(), len(key) - cut

    return run


def _dimensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows have each dimension, and of those whose value is not a small whole number."""
    for b in batches:
        x, good = unit_rows(b.column(0), None, False)
        x = x[good]
        odd = (x != np.rint(x)) | (np.abs(x) > 127)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(np.count_nonzero(x, axis=0)), pa.array(odd.sum(0)), pa.array(np.full(x.shape[1], len(x)))], ["at", "times", "odd", "rows"])


def sparse_join(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of rows (id, v) of cosine ``least`` or more, rounded to six digits.

    Vectors have one width and few dimensions other than zero; one without any, or null, meets none.
    """
    numbered = materialize(rows.where("v IS NOT NULL").select(F.monotonically_increasing_id().alias("n"), "id", "v"), "numbered")
    seen = numbered.select("v").mapInArrow(_dimensions, "at long, times long, odd long, rows long").groupBy("at").agg(F.sum("times"), F.sum("odd"), F.max("rows"), F.sum("rows")).orderBy("at").collect()
    order = sorted(range(len(seen)), key=lambda k: (seen[k][1], k))
    whole, width = not any(r[2] for r in seen), len(seen)
    level = plan_level(seen[0][4] if seen else 0, width)
    vectors = numbered.select("n", "v")
    levels = tuple(sorted(r.own for r in vectors.mapInArrow(_keyed(least, level, order, whole, (), False), "own long").distinct().collect())) if seen else ()
    if not levels:
        return numbered.join(numbered.select(F.col("id").alias("b")).limit(0), F.lit(True)).select(F.col("id").alias("a"), "b", F.lit(0.0).alias("similarity"))
    names = vectors.mapInArrow(_keyed(least, level, order, whole, levels, False), "key long")
    crowded = materialize(names.groupBy("key").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts")).where("parts > 1"), "crowded")
    keyed = vectors.mapInArrow(_keyed(least, level, order, whole, levels, True), "key long, mass double, n long, blob binary")
    if crowded.limit(1).count():
        parts = keyed.join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = parts.select("key", "mass", "n", "blob", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("n"), F.col("parts")).cast("int").alias("home"))
    else:
        dealt = keyed.select("key", "mass", "n", "blob", F.lit(0).alias("part"), F.lit(0).alias("home"))
    met = dealt.repartition("key", "part").sortWithinPartitions("key", "part", F.desc("mass"), "n").mapInArrow(_meet(least, width, whole), "a long, b long, similarity double")
    ids = numbered.select("n", "id")
    named = met.join(ids.select(F.col("n").alias("a"), F.col("id").alias("p")), "a").join(ids.select(F.col("n").alias("b"), F.col("id").alias("q")), "b")
    return named.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")
