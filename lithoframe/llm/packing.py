"""Best-two-fit packing of tokenized documents into fixed-size sequences.

Each document is tokenized and given an end id; one longer than a sequence is
cut into full pieces and a last, shorter one.  Pieces are then packed by
best-two-fit: a bin is filled greedily with the largest piece that fits, and
its smallest piece is replaced by two unpacked ones as long as a pair fills the
expanded gap more tightly.

Two pieces of one length are interchangeable, so the packing is decided on the
histogram of lengths, which has at most ``capacity`` entries however large the
corpus is.  The plan says, for each length, which ranks among the pieces of
that length go to which sequences and offsets; every piece then finds its place
from its own rank.  No task ever holds a group: a length with many pieces is
ranked in buckets of about `BUCKET_ROWS`, and bucket starts are running sums.

Edge cases: a null or empty text is its end id alone; a very long one is encoded
whole and cut; repeated rows are packed each for itself; pieces of equal length
take their places in order of id and piece; an empty table gives an empty table; other input columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lithoframe.llm.common import collector_paused, materialize, small_batches, table

#: A gap of at most 1 / SLACK of a sequence is tight: nothing is replaced for it, which
#: would only spend the pairs that wider gaps need.
SLACK = 128
#: Pieces of one length that are ranked together.
BUCKET_ROWS = 512
#: Distinct chunks after which a Python worker starts a new memory; it keeps the one before (about 200 bytes a chunk).
CACHE_ENTRIES = 300_000


class WordEncoder:
    """Ids of whole texts for a vocabulary whose pre-tokenizer drops white space.

    No pre-token spans white space, so a text's ids are those of its chunks in
    order; chunks repeat, so the library sees each distinct one once.  A letter
    run followed by ASCII punctuation splits further, and ASCII letter runs are
    lower-cased first, as the vocabulary's normalizer does itself.  New
    letter runs are encoded many to a text: each ends with its only token that
    carries the end-of-word mark, which tells where its ids end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        vocab = self.model.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _letter_runs(self, runs: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(runs), 2000):
            part = runs[at : at + 2000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            if len(ends) != len(part):  # a character the two sides class differently
                out += self._direct(part)
                continue
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _learn(self, new: list[str]) -> None:
        known = self.known
        runs, others, built = set(), set(), []
        for c in new:
            if c.isalpha():
                if c.isascii() and not c.islower():
                    core = c.lower()
                    built.append((c, core, ""))
                    if core not in known:
                        runs.add(core)
                else:
                    runs.add(c)
                continue
            core = c.rstrip(punctuation)
            if not core.isalpha() or "<|" in c:
                others.add(c)
                continue
            tail = c[len(core) :]
            if core.isascii():
                core = core.lower()
            if core not in known:
                runs.add(core)
            if tail not in known:
                others.add(tail)
            built.append((c, core, tail))
        letters, whole = list(runs), list(others)
        known.update(zip(letters, self._letter_runs(letters)))
        known.update(zip(whole, self._direct(whole)))
        for c, core, tail in built:
            known[c] = known[core] + known[tail] if tail else known[core]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (and the last end)."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        missing = [c for c in chunks if c not in known]
        known.update((c, older[c]) for c in missing if c in older)
        self._learn([c for c in missing if c not in older] if older else missing)
        found = pa.array(list(map(self.known.__getitem__, chunks)), pa.binary()).take(coded.indices)
        ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1) if len(found) else np.zeros(1, np.int32)
        ids = np.frombuffer(found.buffers()[2], "<u4", ends[-1] // 4) if ends[-1] else np.empty(0, "<u4")
        return ids, ends[split.offsets.to_numpy() - split.offsets[0].as_py()].astype(np.int64) // 4


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


def tokenize_pieces(df: DataFrame, tokenizer_path: str, *, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    fields = [StructField(id_col, df.schema[id_col].dataType), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    schema = StructType(fields)
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        with collector_paused():
            for batch in batches:
                for first in range(0, batch.num_rows, 1024):
                    ids, bounds = encode(batch.column(1).slice(first, 1024))
                    data, bounds = ids.tobytes(), (4 * bounds).tolist()
                    row, piece, length, crc, kept = [], [], [], [], []
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        one = data[a:b] + end
                        for p, at in enumerate(range(0, len(one), step)):
                            cut = one[at : at + step]
                            row.append(first + k)
                            piece.append(p)
                            length.append(len(cut) // 4)
                            crc.append(zlib.crc32(cut))
                            if with_ids:
                                kept.append(np.frombuffer(cut, "<i4"))
                    out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array([p * capacity for p in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        out.append(pa.array(kept, pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return small_batches(rows).mapInArrow(run, schema)


def _best_pair(alive: list[int], left: dict[int, int], above: int, most: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum in (above, most], the most even such pair.

    The search goes outwards from half the sum, so that the shortest pieces, which
    later bins need for their last gaps, are not spent first.
    """
    best, found = above, None
    i = bisect_right(alive, most // 2) - 1
    j = i
    if i >= 0 and left[alive[i]] < 2:
        j = i + 1
        if i and alive[i - 1] + alive[i] > best:
            best, found = alive[i - 1] + alive[i], (alive[i - 1], alive[i])
    while i >= 0 and j < len(alive):
        total = alive[i] + alive[j]
        if total > most:
            i -= 1
            continue
        if total > best:
            best, found = total, (alive[i], alive[j])
            if best == most:
                break
        j += 1
    return found


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bin contents (length -> pieces) and how many bins are filled so: best-two-fit on counts."""
    left = {n: c for n, c in histogram.items() if c > 0}
    alive = sorted(left)
    out: list[tuple[dict[int, int], int]] = []
    while alive:
        taken: dict[int, int] = {}
        gap = capacity

        def take(n: int, k: int) -> None:
            taken[n] = taken.get(n, 0) + k
            left[n] -= k

        while (at := bisect_right(alive, gap) - 1) >= 0:
            while at >= 0 and not left[alive[at]]:
                at -= 1
            if at < 0:
                break
            k = min(left[alive[at]], gap // alive[at])
            take(alive[at], k)
            gap -= k * alive[at]
        while gap > capacity // SLACK:
            least = min(taken)
            unpacked = [n for n in alive if left[n]]
            pair = _best_pair(unpacked, left, least, least + gap)
            if pair is None:
                break
            taken[least] -= 1
            left[least] += 1
            if not taken[least]:
                del taken[least]
            for n in pair:
                take(n, 1)
            gap -= sum(pair) - least
        again = min(left[n] // k for n, k in taken.items())
        for n, k in taken.items():
            left[n] -= again * k
        out.append((taken, again + 1))
        alive = [n for n in alive if left[n]]
    return out


def placements(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces per bin, first sequence, first offset), sorted."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for taken, times in bins:
        offset = 0
        for n in sorted(taken, reverse=True):
            rows.append((n, rank.get(n, 0), taken[n], sequence, offset))
            rank[n] = rank.get(n, 0) + taken[n] * times
            offset += n * taken[n]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (a materialized table with `length`) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    plan = placements(plan_bins(counts, capacity))
    buckets = spark.createDataFrame([(n, -(-c // BUCKET_ROWS)) for n, c in counts.items()], "length long, __buckets int")
    keyed = pieces.join(F.broadcast(buckets), "length").withColumn("__bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.col("__buckets")))
    starts = (
        keyed.groupBy("length", "__bucket")
        .agg(F.count("*").alias("__n"))
        .withColumn("__first", F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "__bucket", F.coalesce("__first", F.lit(0)).alias("__first"))
    )
    order = Window.partitionBy("length", "__bucket").orderBy(id_col, "piece", "ids_crc32")
    ranked = keyed.withColumn("__in", F.row_number().over(order) - 1).join(starts, ["length", "__bucket"]).withColumn("__rank", F.col("__first") + F.col("__in"))
    ranked = ranked.select(*pieces.columns, "__rank")
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << 48
        keys = plan[:, 0] * wide + plan[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            local = rank - plan[at, 1]
            sequence = plan[at, 3] + local // plan[at, 2]
            offset = plan[at, 4] + local % plan[at, 2] * length
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    Columns: id, piece, start, length, ids_crc32, (ids), sequence_id, offset.
    """
    pieces = tokenize_pieces(df, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids)
    return pack_pieces(materialize(pieces, "pieces"), capacity, id_col)


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
