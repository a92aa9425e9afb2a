"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded; learned filters, eight bytes wide and four apart,
slide over the whole document, however long.  Responses are max-pooled within
chunks of 1,024 bytes that overlap by half; the mean and the maximum of the
chunks' values feed a small layer that gives one probability.  Tiles of a fixed
size bound the memory; a chunk's value depends on its own document only.

Training reads labelled rows with hash(id) mod ``folds`` other than the held-out
fold.  It uses a bounded sample, `TRAIN_ROWS` rows of at most `TRAIN_BYTES`
bytes each, chosen by a hash of the id: more labels do not change the fixed cost
or the size of what is sent to the executors.  Only whole texts are used; longer
ones are left out of the sample and not cut.

Edge cases: null and empty texts are scored like any other (as one empty chunk);
null labels are not learned from; without labels of both kinds every score is
the share of label 1 (0.5 without labels); repeated rows get equal scores, and of
texts that share an id the least in order is learned from; very long texts are
scored whole; the sample is the labelled ids of least hash, so there are no ties; a
null id is never learned from and not held out; other input columns are never
inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lithoframe.llm.common import small_batches, table, text_or_empty

#: Bounds of the sample that is learned from: rows, and UTF-8 bytes of each.
TRAIN_ROWS, TRAIN_BYTES = 4000, 30_000
STRIDE, HALF = 4, 512
_TILE = 1 << 18


class ByteNet:
    """Embedding, filters, pooling and the layers above them."""

    def __init__(self, seed: int = 7, dim: int = 8, filters: int = 48, hidden: int = 24):
        r = np.random.default_rng(seed)
        f = np.float32
        self.w = {
            "emb": r.normal(0, 0.5, (256, dim)).astype(f),
            "conv": r.normal(0, (2 * STRIDE * dim) ** -0.5, (STRIDE * dim, 2 * filters)).astype(f),
            "cb": np.zeros(filters, f),
            "h": r.normal(0, (2 * filters) ** -0.5, (2 * filters, hidden)).astype(f),
            "hb": np.zeros(hidden, f),
            "o": r.normal(0, hidden**-0.5, hidden).astype(f),
            "ob": np.zeros(1, f),
        }
        self.w["emb"][0] = 0
        self.filters = filters

    def lay_out(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts padded to whole half chunks in one array, and their numbers of half chunks."""
        halves = np.array([max(1, -(-len(t) // HALF)) for t in texts])
        data = np.zeros(int(halves.sum()) * HALF, np.uint8)
        at = 0
        for t, n in zip(texts, halves.tolist()):
            data[at : at + len(t)] = np.frombuffer(t, np.uint8)
            at += n * HALF
        return data, halves

    def responses(self, data: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses every STRIDE bytes; ``last`` are rows that end a document."""
        rows = self.w["emb"][data].reshape(len(data) // STRIDE, -1)
        both = rows @ self.w["conv"]
        out, after = both[:, : self.filters], both[:, self.filters :]
        keep = after[last + 1].copy() if len(last) and last[-1] + 1 < len(after) else after[last[:-1] + 1].copy()
        out[:-1] += after[1:]
        out[last[: len(keep)]] -= keep
        return out + self.w["cb"], rows

    def pooled(self, data: np.ndarray, halves: np.ndarray, want_rows: bool = False):
        """Maxima of half chunks (and, for training, where they are)."""
        per = HALF // STRIDE
        last = np.cumsum(halves) * per - 1
        out, rows = self.responses(data, last)
        out = out.reshape(-1, per, self.filters)
        if not want_rows:
            return np.maximum(out.max(1), 0)
        at = out.argmax(1)
        top = np.take_along_axis(out, at[:, None, :], 1)[:, 0, :]
        return np.maximum(top, 0), top > 0, at + np.arange(len(at))[:, None] * per, rows, last

    @staticmethod
    def chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second half of every overlapping chunk, and where each document's chunks begin."""
        n = np.maximum(halves - 1, 1)
        begins = np.cumsum(n) - n
        first = np.arange(n.sum()) - np.repeat(begins, n) + np.repeat(np.cumsum(halves) - halves, n)
        second = first + np.repeat(halves > 1, n)
        return first, second, begins

    def features(self, tops: np.ndarray, halves: np.ndarray) -> np.ndarray:
        first, second, begins = self.chunks(halves)
        top = np.maximum(tops[first], tops[second])
        mean = np.add.reduceat(top, begins) / np.maximum(halves - 1, 1)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(top, begins)], 1)

    def head(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(x @ self.w["h"] + self.w["hb"], 0)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.w["o"] + self.w["ob"], -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of label 1; long documents go through in tiles."""
        out, group, size = [], [], 0
        for t in texts:
            if len(t) > _TILE:
                out.append(self._score_some(group))
                out.append(self._score_long(t))
                group, size = [], 0
                continue
            if size + len(t) > _TILE:
                out.append(self._score_some(group))
                group, size = [], 0
            group.append(t)
            size += len(t) + HALF
        out.append(self._score_some(group))
        return np.concatenate(out)

    def _score_some(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        data, halves = self.lay_out(texts)
        return self.head(self.features(self.pooled(data, halves), halves))[1].astype(np.float64)

    def _score_long(self, text: bytes) -> np.ndarray:
        tops = []
        for at in range(0, len(text), _TILE):
            data, halves = self.lay_out([text[at : at + _TILE + HALF]])
            part = self.pooled(data, halves)
            tops.append(part[: _TILE // HALF] if at + _TILE < len(text) else part[: -(-(len(text) - at) // HALF)])
        top = np.concatenate(tops)
        return self.head(self.features(top, np.array([len(top)])))[1].astype(np.float64)

    def gradients(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        data, halves = self.lay_out(texts)
        tops, on, at, rows, last = self.pooled(data, halves, True)
        x = self.features(tops, halves)
        hidden, p = self.head(x)
        loss = float(-(weights * np.log(np.where(labels == 1, p, 1 - p) + 1e-7)).sum())
        d = ((p - labels) * weights).astype(np.float32)
        g = {"o": hidden.T @ d, "ob": d.sum(keepdims=True)}
        dh = np.outer(d, self.w["o"]) * (hidden > 0)
        g["h"], g["hb"] = x.T @ dh, dh.sum(0)
        dx = dh @ self.w["h"].T
        f = self.filters
        first, second, begins = self.chunks(halves)
        n = np.maximum(halves - 1, 1)
        doc = np.repeat(np.arange(len(halves)), n)
        top = np.maximum(tops[first], tops[second])
        best = np.maximum.reduceat(top, begins)[doc] == top
        seen = np.cumsum(best, 0)
        best &= seen - (seen[begins] - best[begins])[doc] == 1  # overlapping chunks share their maximum; it counts once
        dtop = dx[doc, :f] / n[doc, None] + dx[doc, f:] * best
        take = tops[first] >= tops[second]
        dhalf = np.zeros_like(tops)
        np.add.at(dhalf, first, dtop * take)
        np.add.at(dhalf, second, dtop * ~take)
        dhalf *= on
        g["cb"] = dhalf.sum(0)
        width = rows.shape[1]
        conv, drows = np.zeros_like(self.w["conv"]), np.zeros_like(rows)
        ends = np.zeros(len(rows) + 1, bool)
        ends[last] = True
        for k in range(f):
            r, v = at[:, k], dhalf[:, k : k + 1]
            conv[:, k] = (rows[r] * v).sum(0)
            np.add.at(drows, r, v * self.w["conv"][:, k])
            inside = ~ends[r]
            r, v = r[inside] + 1, v[inside]
            conv[:, f + k] = (rows[r] * v).sum(0)
            np.add.at(drows, r, v * self.w["conv"][:, f + k])
        g["conv"] = conv
        used = np.flatnonzero(np.abs(drows).sum(1))
        emb = np.zeros_like(self.w["emb"])
        np.add.at(emb, data.reshape(-1, STRIDE)[used], drows[used].reshape(len(used), STRIDE, width // STRIDE))
        emb[0] = 0
        g["emb"] = emb
        return g, loss

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.004) -> ByteNet:
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        r, step = np.random.default_rng(11), 0
        share = float(labels.mean())
        self.w["ob"][:] = np.log(share / (1 - share))
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                g, _ = self.gradients([texts[k] for k in part], labels[part], np.full(len(part), 1 / len(part)))
                step += 1
                now = rate * (1 - 0.9 * epoch / epochs)
                for k, d in g.items():
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.01 * (d * d - v[k])
                    self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def fold(id_col: str, folds: int = 3) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out: int = 1) -> ByteNet | float:
    """The network fitted on the bounded sample, or the share of label 1 where it cannot be."""
    chosen = labels.where((fold(id_col, folds) != held_out) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    texts = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")).where(F.octet_length("__text") <= TRAIN_BYTES)
    sample = chosen.orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_ROWS)
    rows = texts.join(F.broadcast(sample), "__id").groupBy("__id").agg(F.min("__text").alias("__text"), F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_ROWS).collect()
    y = np.array([r["__y"] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return ByteNet().fit([r["__text"].encode() for r in rows], y)


def score_quality(docs: DataFrame, model: ByteNet | float, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, score and predicted of every row; or the ``carry`` columns, __score and __predicted."""
    kept = [f"__c{k}" for k in range(len(carry))]
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"), *[F.col(c).alias(k) for c, k in zip(carry, kept)])
    schema = StructType([*(f for f in rows.schema.fields if f.name != "__text"), StructField("__score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                scores = np.full(len(texts), model) if isinstance(model, float) else model.score(texts)
                columns = [part.column(k) for k in range(part.num_columns) if k != 1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=schema.names)

    done = small_batches(rows).mapInArrow(run, schema)
    predicted = (F.col("__score") >= 0.5).cast("int")
    if carry:
        return done.select(*[F.col(k).alias(c) for c, k in zip(carry, kept)], "__score", predicted.alias("__predicted"))
    return done.select(F.col("__id").alias(id_col), F.col("__score").alias("score"), predicted.alias("predicted"))


def op9_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", "predicted")
