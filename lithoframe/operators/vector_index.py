"""An inverted-file index for vectors: coarse cells, exact ranking inside the cells that are read.

Centroids come from spherical k-means on a bounded sample (`SAMPLE` rows of least
hash); every row is assigned to its nearest centroid and stored in that cell's
partition, so a search reads only the cells it probes, and large cells are split
over files.  How many cells a search has to probe for a wanted recall is measured on
the same sample when the index is built.

A search ranks what it reads by exact cosine.  Filters apply to the rows, and if they
leave fewer than k, further cells are read.  An exact search goes on until no cell
that is left can hold a nearer vector: a cell's greatest angle to its centroid bounds
the similarity to everything in it.

Null vectors, zero vectors and vectors of another length are stored in cell -1, which
no search reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lithoframe.operators.search import top_per_group, vector_search

#: Rows that centroids and probes are fitted on, and the most cells.
SAMPLE, MOST_CELLS = 16_384, 4096
#: Rows of a cell, and queries, that meet in one task as one matrix product.
BLOCK, QUERIES = 8192, 2048


def unit_rows(column: pa.Array, width: int | None, scale: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column and which rows have one (not null, not zero, of ``width`` numbers); as they are without ``scale``."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    width = width if width is not None else int(sizes.max(initial=0))
    good = sizes == width
    if column.null_count or not good.all():
        column = column.filter(pa.array(good))
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width) if width else np.empty((int(good.sum()), 0))
    norms = np.sqrt((flat * flat).sum(1))
    sound = np.isfinite(norms) & (norms > 0)
    out = np.zeros((len(sizes), width))
    out[np.flatnonzero(good)[sound]] = flat[sound] / norms[sound, None] if scale else flat[sound]
    good[good] = sound
    return out, good


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from the first ``cells`` rows; an empty cell takes the row farthest from its centroid."""
    centroids = x[:cells].copy()
    for _ in range(rounds):
        s = x @ centroids.T
        near, fit = s.argmax(1), s.max(1)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centroids)) == 0)
        total[empty] = x[np.argsort(fit, kind="stable")[: len(empty)]]
        norms = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, total / np.maximum(norms, 1e-12), centroids)
    return centroids


def probes_for(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, queries: int = 512) -> int:
    """Fewest nearest cells that hold the wanted share of the k true nearest, other than itself, of sample rows."""
    if len(x) <= 1:
        return 1
    asked = x[:: max(1, len(x) // queries)][:queries]
    s = asked @ x.T
    s[np.arange(len(asked)), np.arange(len(x))[:: max(1, len(x) // queries)][: len(asked)]] = -2
    k = min(k, len(x) - 1)
    true = np.argpartition(-s, k - 1, axis=1)[:, :k]
    cell = (x @ centroids.T).argmax(1)
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.sort(np.take_along_axis(place, cell[true], 1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    id_col: str
    vector_col: str
    centroids: np.ndarray
    sizes: np.ndarray
    angles: np.ndarray
    probes: int

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def bounds(self, vector: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """Cells that hold rows, nearest first, and the greatest similarity that each can have to ``vector``."""
        v = np.asarray(vector, np.float64)
        if len(v) != self.centroids.shape[1]:
            return np.empty(0, np.int64), np.empty(0)
        angle = np.arccos(np.clip(self.centroids @ (v / max(float(np.linalg.norm(v)), 1e-300)), -1, 1))
        held = np.flatnonzero(self.sizes)
        order = held[np.argsort(angle[held], kind="stable")]
        return order, np.cos(np.maximum(angle - self.angles, 0))[order]

    def search(self, vector: Sequence[float], k: int, *, where: Column | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """As `vector_search` on the cells that are read: rows, similarity and pos."""
        order, most = self.bounds(vector)
        at, step, best, schema = 0, max(1, probes or self.probes), [], None
        while True:
            part = self.rows().where(F.col("cell").isin(order[at : at + step].tolist()))
            found = vector_search((part if where is None else part.where(where)).drop("cell", "angle"), vector, k, id_col=self.id_col, vector_col=self.vector_col)
            schema = found.schema
            best = sorted([*best, *found.collect()], key=lambda r: (-r["similarity"], r[self.id_col]))[:k]
            at, step = at + step, step * 2
            if at >= len(order) or (len(best) == k and (not exact or most[at:].max() < best[-1]["similarity"] - 1e-6)):
                break
        return self.spark.createDataFrame([(*tuple(r)[:-1], n) for n, r in enumerate(best, 1)], schema)

    def neighbours(self, queries: DataFrame, k: int, *, probes: int | None = None) -> DataFrame:
        """(q, i, similarity, pos): the k nearest rows, other than itself, in the cells probed for every row of ``queries``.

        A query whose nearest cells hold k rows or fewer goes on to further ones.
        """
        centroids, held, n = self.centroids, self.sizes, probes or self.probes
        asked = queries.select(F.col(self.id_col).alias("q"), F.col(self.vector_col).alias("v"))
        schema = StructType([asked.schema["q"], asked.schema["v"], StructField("cell", IntegerType())])

        def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, good = unit_rows(b.column(1), centroids.shape[1])
                rows = np.flatnonzero(good)
                near = np.argsort(-(x[rows] @ centroids.T), axis=1, kind="stable")
                before = np.cumsum(held[near], axis=1) - held[near]
                read = ((np.arange(near.shape[1]) < n) | (before <= k)) & (held[near] > 0)
                take = pa.array(np.repeat(rows, read.sum(1)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(near[read], pa.int32())], names=schema.names)

        aimed = asked.mapInArrow(aim, schema)
        indexed = self.rows().where("cell >= 0").select(F.col(self.id_col).alias("i"), F.col(self.vector_col).alias("v"), "cell")
        sizes = self.spark.createDataFrame([(c, int(s)) for c, s in enumerate(self.sizes)], "cell int, n long")
        parts = max(1, -(-queries.count() // QUERIES))
        return meet_in_blocks(aimed, indexed, sizes, parts, k)


def meet_in_blocks(asked: DataFrame, rows: DataFrame, sizes: DataFrame, parts: int, k: int, scale: bool = True) -> DataFrame:
    """(q, i, similarity, pos) for queries (q, v, cell) and rows (i, v, cell) that meet by cell.

    A cell's rows are dealt to blocks of about `BLOCK` and its queries to ``parts``;
    each block meets each part in a task of its own, as one matrix product that gives
    k rows a query at most.  ``sizes`` (cell, n) has a bounded number of rows.  Without
    ``scale`` similarity is the dot product.
    """
    blocks = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    left = asked.join(blocks, "cell").where("blocks > 0").select("q", "v", "cell", F.pmod(F.xxhash64("q"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = rows.join(blocks, "cell").select("i", "v", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int").alias("block"))
    schema = StructType([asked.schema["q"], rows.schema["i"], StructField("similarity", DoubleType())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks().sort_by("i")
        empty = pa.table([pa.array([], f) for f in (a["q"].type, b["i"].type, pa.float64())], names=schema.names)
        if not len(a) or not len(b):
            return empty
        x, good = unit_rows(a["v"].combine_chunks(), None, scale)
        y, held = unit_rows(b["v"].combine_chunks(), x.shape[1], scale)
        if not good.any() or not held.any():
            return empty
        p, q = np.flatnonzero(good), np.flatnonzero(held)
        s = np.round(x[p] @ y[q].T, 6)
        top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
        own, other = a["q"].take(pa.array(np.repeat(p, top.shape[1]))), b["i"].take(pa.array(q[top].ravel()))
        out = pa.table([own, other, pa.array(np.take_along_axis(s, top, 1).ravel())], names=schema.names)
        return out.filter(pc.fill_null(pc.not_equal(own, other), True)) if own.type == other.type else out

    keys = ["cell", "part", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    return top_per_group(met, "q", [F.desc("similarity"), F.col("i")], k, "pos")


def build_index(df: DataFrame, path: str, *, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None, k: int = 10, recall: float = 0.98) -> VectorIndex:
    """Fit, assign and store; ``cells`` is the root of the number of rows unless given, `MOST_CELLS` at most."""
    spark = df.sparkSession
    cells = cells or min(MOST_CELLS, max(1, round(math.sqrt(df.count()))))
    first = df.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(vector_col).collect()
    x, good = unit_rows(pa.array([r[0] for r in first], pa.list_(pa.float64())), None)
    x = x[good]
    centroids = fit_centroids(x, min(cells, len(x))) if len(x) else np.zeros((1, x.shape[1]))
    probes = probes_for(x, centroids, k, recall)
    width, schema = centroids.shape[1], StructType([*df.schema.fields, StructField("angle", DoubleType()), StructField("cell", IntegerType())])
    at = df.columns.index(vector_col)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, sound = unit_rows(b.column(at), width)
            s = v @ centroids.T
            cell = np.where(sound, s.argmax(1), -1)
            angle = np.where(sound, np.arccos(np.clip(s.max(1), -1, 1)), np.nan)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angle), pa.array(cell, pa.int32())], names=schema.names)

    df.mapInArrow(assign, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    held = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()} if len(x) else {}
    table = [(c, centroids[c].tolist(), held[c]["n"] if c in held else 0, held[c]["angle"] if c in held else 0.0, probes, id_col, vector_col) for c in range(len(centroids))]
    spark.createDataFrame(table, "cell int, centroid array<double>, n long, angle double, probes int, id_col string, vector_col string").coalesce(1).write.parquet(f"{path}/cells")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that `build_index` stored."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return VectorIndex(spark, path, cells[0].id_col, cells[0].vector_col, np.array([r.centroid for r in cells], np.float64), np.array([r.n for r in cells]), np.array([r.angle for r in cells]), cells[0].probes)


def knn_join(left: DataFrame, right: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(q, i, similarity, pos): for every row of ``left`` the k rows of ``right``, other than itself, of greatest dot product.

    Exact: blocks of both sides meet in tasks of bounded size.  Vectors are taken to be of unit length.
    """
    asked = left.select(F.col(id_col).alias("q"), F.col(vector_col).alias("v"), F.lit(0).alias("cell"))
    rows = right.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"), F.lit(0).alias("cell"))
    return meet_in_blocks(asked, rows, right.agg(F.lit(0).alias("cell"), F.count("*").alias("n")), max(1, -(-left.count() // QUERIES)), k, scale=False)


