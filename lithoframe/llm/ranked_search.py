"""Ranked lexical search: variable-block-max WAND over document shards.

The documents are indexed in shards, one row each: sorted terms, and for each term
its postings (documents in ascending id order, and counts).  A shard holds at most
`SHARD_BYTES` of text or `SHARD_DOCS` documents (or one longer document), so it is
built and searched in bounded memory, and a search is a map over shards without a
shuffle.

For a search, a term's postings in a shard are cut into blocks of variable length.
Dynamic programming finds, among all cuts into blocks of at most `LONGEST`
postings, the one of least bound error (a block's greatest impact less each
posting's own, summed) plus `PRICE` for each block; all terms of a shard go
through it in step.  A document's bound is the sum of its query terms' block
maxima: a dense block counts for the whole range that it spans, a sparse one, as
in WAND's choice of a pivot, for the documents of its postings only.  Only
documents whose bound reaches the k-th best score so far are scored; this loses no
result, whatever the order, and the documents of highest bounds are scored first,
so the threshold rises early.

The queries are a stated set: they go out in blocks of at most `QUERY_CHARS`
characters, one map over the shards for each.  A shard gives its k best documents
for a query; the best of all are chosen in two steps, so that no task receives the
lists of all shards for a query.

Edge cases: null and empty texts have no terms, count for nothing and are found by
nothing; queries without terms have no results; equal rows are documents of their
own, with ranks of their own; equal queries count once; ids may be of any type that
has an order, null ids rank last among equal scores; very long texts are read
whole; without documents there are no results; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lithoframe.llm.common import materialize, small_batches, table, text_or_empty

SHARD_BYTES, SHARD_DOCS = 16 << 20, 8192
QUERY_CHARS = 1 << 20
#: The longest block, and a block's price in impact units (impacts are below 1,000,000).
LONGEST, PRICE = 64, 1_000_000
#: Groups that the shards' lists of one query are dealt to before the last choice.
SPREAD = 64
#: A block is sparse if it spans more than so many documents for each posting.
SPARSE = 2

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all other code points from U+0080; A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


class ShardWriter:
    """Collects documents and gives the row of their shard."""

    def __init__(self, vocabulary: dict[bytes, int] | None):
        self.fixed = vocabulary
        self.clear()

    def clear(self) -> None:
        self.numbers = self.fixed if self.fixed is not None else {}
        self.ids: list = []
        self.lengths: list[int] = []
        self.hits: tuple[list[int], list[int], list[int]] = [], [], []
        self.size = self.n_docs = self.n_terms = 0

    @property
    def full(self) -> bool:
        return self.size >= SHARD_BYTES or self.n_docs >= SHARD_DOCS

    def add(self, id_, text: bytes) -> None:
        terms = terms_of(text)
        if not terms:
            return
        self.size += len(text)
        self.n_docs += 1
        self.n_terms += len(terms)
        counts = Counter(terms)
        numbers = self.numbers
        if self.fixed is None:
            hits = [(numbers.setdefault(t, len(numbers)), n) for t, n in counts.items()]
        else:
            hits = [(numbers[t], counts[t]) for t in counts.keys() & numbers.keys()]
        if hits:
            term, doc, count = self.hits
            term.extend(h[0] for h in hits)
            doc.extend([len(self.ids)] * len(hits))
            count.extend(h[1] for h in hits)
            self.ids.append(id_)
            self.lengths.append(len(terms))

    def row(self) -> dict:
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] if self.ids[k] is not None else 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, doc, count = (np.array(x, np.int64) for x in self.hits)
        doc = place[doc] if len(doc) else doc
        spelled = sorted(self.numbers, key=self.numbers.get)
        rank = np.empty(len(spelled), np.int64)
        rank[sorted(range(len(spelled)), key=spelled.__getitem__)] = np.arange(len(spelled))
        term = rank[term] if len(term) else term
        by = np.lexsort((doc, term))
        term, doc, count = term[by], doc[by], count[by]
        present, sizes = np.unique(term, return_counts=True)
        spelled.sort()
        return {
            "n_docs": self.n_docs,
            "n_terms": self.n_terms,
            "ids": [self.ids[k] for k in order],
            "lengths": [self.lengths[k] for k in order],
            "terms": [spelled[t].decode() for t in present.tolist()],
            "sizes": sizes,
            "docs": doc,
            "counts": count,
        }


def index_documents(docs: DataFrame, *, terms: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard, with the postings of all terms or of ``terms`` only; written to the shared folder."""
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    whole = ArrayType(IntegerType())
    schema = StructType(
        [
            StructField("n_docs", LongType()),
            StructField("n_terms", LongType()),
            StructField("ids", ArrayType(docs.schema[id_col].dataType)),
            StructField("lengths", ArrayType(LongType())),
            StructField("terms", ArrayType(StringType())),
            StructField("sizes", whole),
            StructField("docs", whole),
            StructField("counts", ArrayType(LongType())),
        ]
    )
    vocabulary = None if terms is None else {t.encode(): k for k, t in enumerate(sorted(set(terms)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, kind = ShardWriter(vocabulary), None

        def shard() -> pa.RecordBatch:
            row = writer.row()
            kinds = [pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            out = pa.RecordBatch.from_arrays([pa.array([row[name]], k) for name, k in zip(schema.names, kinds)], names=schema.names)
            writer.clear()
            return out

        for batch in batches:
            kind = batch.column(0).type
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                for id_, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    writer.add(id_, text)
                    if writer.full:
                        yield shard()
        if writer.n_docs:
            yield shard()

    return materialize(small_batches(rows).mapInArrow(run, schema), "postings")


def cut_blocks(impacts: np.ndarray, starts: np.ndarray, longest: int = LONGEST, price: int = PRICE) -> np.ndarray:
    """Where the blocks begin.  List t of ``impacts`` begins at starts[t] and ends where the next begins.

    cost(i) is the least cost of a list's first i postings: the minimum over j of
    cost(i - j) + j * (greatest of the last j) + price; the impacts' own sum is the
    same for every cut.  Step i is done for all lists longer than i at once.
    """
    sizes = np.diff(np.append(starts, len(impacts)))
    by = np.argsort(-sizes, kind="stable")
    first, size = starts[by], sizes[by]
    back = np.zeros(len(impacts), np.int64)
    far = np.int64(1) << 60
    cost = np.full((len(by), longest), far)
    cost[:, 0] = 0
    top = np.zeros((len(by), longest), np.int64)
    lengths = np.arange(1, longest + 1)
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    for i, n in enumerate(active.tolist()):
        now = impacts[first[:n] + i]
        top = top[:n]
        top[:, 1:] = np.maximum(top[:, :-1], now[:, None])
        top[:, 0] = now
        total = cost[:n] + lengths * top
        best = total.argmin(1)
        back[first[:n] + i] = best + 1
        cost = cost[:n]
        cost[:, 1:] = cost[:, :-1].copy()
        cost[:, 0] = total[np.arange(n), best] + price
    begins = []
    at, low = starts + sizes, starts
    while len(at):
        at = at - back[at - 1]
        begins.append(at)
        more = at > low
        at, low = at[more], low[more]
    return np.sort(np.concatenate(begins)) if begins else np.empty(0, np.int64)


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + n[0] - 1, first[1], ..."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


class Shard:
    """A shard's postings with impacts and blocks, ready for queries."""

    def __init__(self, sizes: np.ndarray, docs: np.ndarray, counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int):
        measure = 75 + 25 * lengths * n_docs // n_terms
        self.width = len(lengths)
        self.docs = docs
        self.impacts = 1_000_000_000 * counts // (1000 * counts + 12 * measure[docs])
        starts = np.cumsum(sizes) - sizes
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * self.width + docs
        begin = cut_blocks(self.impacts, starts)
        end = np.append(begin[1:], len(docs))[: len(begin)] - 1
        self.greatest = np.maximum.reduceat(self.impacts, begin) if len(begin) else np.empty(0, np.int64)
        self.begin, self.length = begin, end + 1 - begin
        self.low, self.high = docs[begin], docs[end] + 1
        self.sparse = self.high - self.low > SPARSE * self.length
        self.block_of = np.searchsorted(begin, np.append(starts, len(docs)))
        self.scored = 0

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every document, the sum of the weighted maxima of the blocks that may hold it."""
        n = self.block_of[terms + 1] - self.block_of[terms]
        which = spans(self.block_of[terms], n)
        value = np.repeat(weights, n) * self.greatest[which]
        sparse = self.sparse[which]
        step = np.zeros(self.width + 1, np.int64)
        np.add.at(step, self.low[which[~sparse]], value[~sparse])
        np.subtract.at(step, self.high[which[~sparse]], value[~sparse])
        bound = np.cumsum(step)[:-1]
        which, value = which[sparse], value[sparse]
        np.add.at(bound, self.docs[spans(self.begin[which], self.length[which])], np.repeat(value, self.length[which]))
        return bound

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        self.scored += len(docs)
        asked = terms[:, None] * self.width + docs
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return (weights[:, None] * np.where(self.keys[at] == asked, self.impacts[at], 0)).sum(0)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents and their scores above 0, best first, equal ones by place."""
        best, worth = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(terms):
            return best, worth
        bound = self.bounds(terms, weights)
        left = np.flatnonzero(bound)
        order = left[np.argsort(-bound[left], kind="stable")]
        at, step = 0, 4 * k
        while at < len(order) and (len(worth) < k or bound[order[at]] >= worth[-1]):
            part = order[at : at + step]
            if len(worth) == k:
                part = part[bound[part] >= worth[-1]]
            best, worth = np.append(best, part), np.append(worth, self.scores(np.sort(part), terms, weights)[np.argsort(np.argsort(part))])
            keep = np.lexsort((best, -worth))[:k]
            keep = keep[worth[keep] > 0]
            best, worth = best[keep], worth[keep]
            at += step
            step *= 2
        return best, worth


def _query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """Distinct (id, text) queries in blocks of about QUERY_CHARS characters; longer texts are blocks of their own."""
    asked = queries.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t")).distinct()
    block, size = [], 0
    for r in asked.toLocalIterator():
        if block and size + len(r.t) > QUERY_CHARS:
            yield block
            block, size = [], 0
        block.append(r)
        size += len(r.t)
    yield block


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def search(index: DataFrame, asked: list[Counter], k: int) -> DataFrame:
    """(query, doc, score): each shard's k best documents for every query of a block (counts of terms)."""
    spark = index.sparkSession
    wanted = sorted(set().union(*asked)) if asked else []
    totals = index.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    n_docs, n_terms = totals.d or 0, totals.t or 0
    holding = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("n"))
    named = spark.createDataFrame([(t.decode(),) for t in wanted], "terms string")
    weights = {r.terms.encode(): weight(n_docs, r.n) for r in holding.join(F.broadcast(named), "terms").collect()}
    wanted = [t for t in wanted if t in weights]
    number = {t: j for j, t in enumerate(wanted)}
    lists = [(np.array([number[t] for t in q if t in number], np.int64), np.array([weights[t] * n for t, n in q.items() if t in number], np.int64)) for q in asked]
    schema = StructType([StructField("query", IntegerType()), StructField("doc", index.schema["ids"].dataType.elementType), StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, lengths, terms, sizes, docs, counts = (batch.column(c)[r].values for c in range(6))
                kept = [(number[t], j) for j, t in enumerate(terms.cast(pa.binary()).to_pylist()) if t in number]
                if not kept:
                    continue
                here = np.full(len(number), -1)
                sizes = sizes.to_numpy().astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                at = np.array([j for _, j in kept], np.int64)
                here[np.array([t for t, _ in kept], np.int64)] = np.arange(len(kept))
                take = spans(starts[at], sizes[at])
                shard = Shard(sizes[at], docs.to_numpy().astype(np.int64)[take], counts.to_numpy()[take], lengths.to_numpy(), n_docs, n_terms)
                found: list[list[np.ndarray]] = [[], [], []]
                for q, (own, worth) in enumerate(lists):
                    inside = here[own] >= 0
                    best, score = shard.search(here[own][inside], worth[inside], k)
                    for column, values in zip(found, (np.full(len(best), q, np.int32), best, score)):
                        column.append(values)
                query, best, score = (np.concatenate(x) if x else np.empty(0, np.int64) for x in found)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), ids.take(pa.array(best)), pa.array(score, pa.int64())], names=schema.names)

    return small_batches(index.select("ids", "lengths", "terms", "sizes", "docs", "counts")).mapInArrow(run, schema)


def best_matches(docs: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """(query_col, rank, id_col, score): the k highest-scoring documents for every query."""
    spark, out = docs.sparkSession, None
    for block in _query_blocks(queries, query_col, query_text_col):
        asked = [Counter(terms_of(r.t.encode())) for r in block]
        index = index_documents(docs, terms=[t.decode() for t in set().union(*asked)] if asked else [], id_col=id_col, text_col=text_col)
        names = spark.createDataFrame([(n, r.i) for n, r in enumerate(block)], StructType([StructField("query", IntegerType()), StructField("__item", queries.schema[query_col].dataType)]))
        lists = search(index, asked, k).withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
        order = [F.desc("score"), F.asc_nulls_last("doc")]
        for keys in (["query", "deal"], ["query"]):
            lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        part = lists.join(F.broadcast(names), "query").select(F.col("__item").alias(query_col), "rank", F.col("doc").alias(id_col), "score")
        out = part if out is None else out.unionByName(part)
    return out


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
measure AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM lengths, totals),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, docs),
asked AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN measure USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""
