"""A stored inverted index that grows by segments and is searched without the corpus.

Every batch becomes a segment of three tables: postings (word, id, hits, positions) in
folders by a hash of the word and sorted by word, so that a search opens the folders of its
own words and skips row groups of others; texts (id, digest), by which an unchanged text
is left out of a later batch; and stale (id, segment), the earlier entries that the
segment replaces or removes.  A search leaves out what is stale; `merge` writes one
segment without it.

A manifest names the segments that count and is written last, so a batch that fails
half-way changes nothing and can be added again.  Frequent words are spread over several
files by Spark's rebalancing.  One writer at a time; the folder can be opened by a later
session.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.operators import search as S
from lithoframe.operators import words as W
from lithoframe.plans.scratch import materialize

SLOTS = 32


def slot(word: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(slots)).cast("int")


class WordIndex:
    """Keyword search over texts that come, change and go in batches.

    A null text has no words; an id that a batch repeats counts once, with the text of
    greatest digest.  Ids may be of any type that can be compared.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", *, slots: int = SLOTS):
        self.spark, self.path, self.id_type, self.slots = spark, path.rstrip("/"), id_type, slots

    def segments(self) -> list[tuple[int, str]]:
        """Number and folder of each segment that counts; a list that `merge` keeps short."""
        return self._manifest()[1]

    def _manifest(self) -> tuple[int, list[tuple[int, str]]]:
        """The manifest's version and its segments."""
        try:
            kept = self.spark.read.schema("segment BIGINT, folder STRING, version BIGINT").parquet(f"{self.path}/manifest")
        except AnalysisException:
            return 0, []
        last = kept.agg(F.max("version")).first()[0] or 0
        return last, sorted((r.segment, r.folder) for r in kept.where(F.col("version") == last).collect() if r.folder)

    def _commit(self, segments: Sequence[tuple[int, str]]) -> None:
        version = self._manifest()[0] + 1
        rows = [(n, folder, version) for n, folder in segments]
        self.spark.createDataFrame(rows, "segment BIGINT, folder STRING, version BIGINT").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _read(self, table: str, columns: str) -> DataFrame:
        parts = [self.spark.read.schema(columns).parquet(f"{folder}/{table}").withColumn("segment", F.lit(n).cast("bigint")) for n, folder in self.segments()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{columns}, segment BIGINT")

    def _texts(self) -> DataFrame:
        return self._read("texts", f"id {self.id_type}, digest STRING")

    def _stale(self) -> DataFrame:
        read = self._read("stale", f"id {self.id_type}, of BIGINT")
        return read.select("id", F.col("of").alias("segment"))

    def live(self, df: DataFrame) -> DataFrame:
        """Rows (id, segment, ...) of entries that no later segment replaces."""
        return df.join(self._stale(), ["id", "segment"], "left_anti")

    def _current(self) -> DataFrame:
        """id, digest and segment of every text that the index holds."""
        return self.live(self._texts())

    def _write(self, segment: int, postings: DataFrame, texts: DataFrame, stale: DataFrame) -> tuple[int, str]:
        folder = f"{self.path}/segment-{segment:06d}-{uuid.uuid4().hex[:8]}"
        placed = postings.select("word", "id", "hits", "positions", slot(F.col("word"), self.slots).alias("slot"))
        placed.hint("rebalance", "slot").sortWithinPartitions("slot", "word", "id").write.partitionBy("slot").parquet(f"{folder}/postings")
        texts.select("id", "digest").write.parquet(f"{folder}/texts")
        stale.select("id", "of").write.parquet(f"{folder}/stale")
        return segment, folder

    def add(self, batch: DataFrame, *, id_col: str = "id", text_col: str = "text") -> int:
        """Index the batch's new and changed texts; the number of these."""
        kept = self.segments()
        rows = batch.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL")
        one = rows.groupBy("id").agg(F.max(F.struct(F.sha2("text", 256).alias("digest"), "text")).alias("r")).select("id", "r.digest", "r.text")
        known = self._current().select("id", F.col("digest").alias("was"), F.col("segment").alias("of"))
        changed = materialize(one.join(known, "id", "left").where("was IS NULL OR was <> digest"), "changed")
        count = changed.count()
        if count:
            postings = W.word_index(changed).withColumn("hits", F.size("positions"))
            number = (kept[-1][0] if kept else 0) + 1
            self._commit([*kept, self._write(number, postings, changed, changed.where("of IS NOT NULL"))])
        return count

    def remove(self, ids: DataFrame, *, id_col: str = "id") -> int:
        """Take texts out; the number of those that were there."""
        kept = self.segments()
        gone = materialize(self._current().join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").select("id", F.col("segment").alias("of")), "gone")
        count = gone.count()
        if count:
            none = self.spark.createDataFrame([], f"word STRING, id {self.id_type}, hits INT, positions ARRAY<INT>, digest STRING")
            self._commit([*kept, self._write(kept[-1][0] + 1, none, none, gone)])
        return count

    def merge(self) -> None:
        """Write all live entries as one segment; the former ones are left to their readers."""
        kept = self.segments()
        if len(kept) > 1:
            none = self.spark.createDataFrame([], f"id {self.id_type}, of BIGINT")
            self._commit([self._write(kept[-1][0] + 1, self.live(self._all()), self._current(), none)])

    def _all(self) -> DataFrame:
        return self._read("postings", f"word STRING, id {self.id_type}, hits INT, positions ARRAY<INT>, slot INT")

    def postings(self, words: Sequence[str]) -> DataFrame:
        """word, id, hits and positions of some words; only their folders are opened."""
        slots = reduce(Column.__or__, [F.col("slot") == slot(F.lit(w), self.slots) for w in words], F.lit(False))
        return self.live(self._all().where(slots & F.col("word").isin(*words))).select("word", "id", "hits", "positions")

    def search(self, query: W.Query, k: int) -> DataFrame:
        """As `words.search_index`: the top ``k`` ids with score."""
        words = {*[w for g in query.groups for w in g], *[w for p in query.phrases for w in p], *query.excluded}
        return W.search_index(self.postings(sorted(words)), query, k)

    def top(self, words: Sequence[str], k: int, *, any_word: bool = False) -> DataFrame:
        """id, score and pos of the top ``k`` texts, as `search.text_search` has them."""
        found = self.search(W.Query(tuple((w,) for w in dict.fromkeys(words)), any_word=any_word), k)
        return S.ranked(found, [F.desc("score"), F.col("id")])

    def hybrid(self, vectors: DataFrame, vector: Sequence[float], words: Sequence[str], **options) -> DataFrame:
        """`search.hybrid_search` whose keyword side reads this index; ``vectors`` has id, doc_id and embedding."""

        def keywords(k: int, any_word: bool) -> DataFrame:
            return vectors.select("id", "doc_id").join(F.broadcast(self.top(words, k, any_word=any_word)), "id")

        return S.hybrid_search(vectors, keywords, vector, words, **options)
