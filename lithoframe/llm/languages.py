"""Language identification: multilingual mixture inference.

Every language has a distribution over hashed byte n-grams, counted over all
training documents and smoothed.  A document is a mixture: expectation-maximisation
estimates the language proportions that make its n-grams likeliest.  The language
set is selected by penalised likelihood: from all languages on, the least one is
dropped and the rest estimated anew, down to a single language; of these sets the
one of greatest log-likelihood less `PENALTY` * log(n-grams) for each language
stays.  Its greatest proportion gives the prediction and the score.

N-grams are `ORDER` bytes of the lower-cased text, in which digits, white space and
ASCII punctuation are one space, so that they bear no weight of their own; they are
counted in `BUCKETS` hashed buckets.  Documents go through the estimation together,
as sparse rows (document, bucket, count), in groups of bounded size.  A model is
`BUCKETS` numbers for each language, whatever the size of the corpus.

Edge cases: a null text and a text without a letter are ``und`` with score 1; so is
every text if no document has a language; texts whose n-grams fit all languages
alike, and ties, go to the language first in order; very long texts are counted
whole, in tiles; repeated rows count and are scored each; a null id is never learned
from and not held out; a null language is not learned from; other columns are no
inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from lithoframe.llm.common import small_batches, table, text_or_empty

BUCKETS, ORDER = 1 << 14, 3
#: Added to every bucket's count; log-likelihood that a further language has to win, in units of log(n-grams); EM steps for each set.
SMOOTHING, PENALTY, STEPS = 0.5, 3.0, 12
_TILE, _GROUP = 1 << 20, 1 << 19

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNKNOWN = "und"


def bucket_ids(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that begin at each byte, and which of them are counted: those without two spaces in a row."""
    n = max(0, len(data) - ORDER + 1)
    h = np.zeros(n, np.uint32)
    blank = data == 32
    double = np.zeros(n, bool)
    for k in range(ORDER):
        h = h * np.uint32(0x01000193) ^ data[k : k + n]
        if k:
            double |= blank[k : k + n] & blank[k - 1 : k - 1 + n]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), ~double


def lowered(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" "


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts: document, bucket, count, in order of document and bucket."""
    parts = [lowered(t) for t in texts]
    if sum(map(len, parts)) <= _TILE:
        data = np.frombuffer(b"".join(parts), np.uint8)
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        ids, good = bucket_ids(data)
        good &= doc[: len(ids)] == doc[ORDER - 1 :]
        keys, n = np.unique(doc[: len(ids)][good] * BUCKETS + ids[good], return_counts=True)
        return keys // BUCKETS, keys % BUCKETS, n.astype(np.float64)
    out = []
    for d, p in enumerate(parts):
        total = np.zeros(BUCKETS)
        data = np.frombuffer(p, np.uint8)
        for at in range(0, len(data), _TILE):
            ids, good = bucket_ids(data[at : at + _TILE + ORDER - 1])
            total += np.bincount(ids[good], minlength=BUCKETS)
        present = np.flatnonzero(total)
        out.append((np.full(len(present), d), present, total[present]))
    return tuple(np.concatenate(x) for x in zip(*out))


class Mixture:
    """Languages and their n-gram probabilities."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.likelihood = (smooth / smooth.sum(1, keepdims=True)).T.copy()

    def estimate(self, p: np.ndarray, count: np.ndarray, begin: np.ndarray, share: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (documents x languages) after EM from ``share``, zeros staying zero, and the log-likelihoods."""
        size = np.diff(np.append(begin, len(count)))
        total = np.add.reduceat(count, begin)[:, None]
        for _ in range(steps):
            part = p * np.repeat(share, size, axis=0)
            part *= (count / part.sum(1))[:, None]
            share = np.add.reduceat(part, begin) / total
        mixed = (p * np.repeat(share, size, axis=0)).sum(1)
        return share, np.add.reduceat(count * np.log(mixed), begin)

    def select(self, doc: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Proportions of the selected language sets, one row for each document in ``doc``."""
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        p = self.likelihood[bucket]
        n, k = len(begin), len(self.languages)
        price = PENALTY * np.log(np.add.reduceat(count, begin) + 1)
        share = np.full((n, k), 1 / k)
        best, worth = share, np.full(n, -np.inf)
        for held in range(k, 0, -1):
            share, fit = self.estimate(p, count, begin, share, STEPS if held > 1 else 0)
            better = fit - held * price >= worth
            worth = np.where(better, fit - held * price, worth)
            best = np.where(better[:, None], share, best)
            least = np.where(share > 0, share, np.inf).argmin(1)
            share = share.copy()
            share[np.arange(n), least] = 0
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
        return best

    def shares(self, texts: list[str]) -> np.ndarray:
        """The selected proportions of every text; equal ones for a text without n-grams."""
        out = np.full((len(texts), len(self.languages)), 1 / len(self.languages))
        doc, bucket, count = counted(texts)
        if len(doc):
            out[np.unique(doc)] = self.select(doc, bucket, count)
        return out


def fold(id_col: str, folds: int = 4) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> Mixture | None:
    """The model of all documents outside the held-out fold that have a language; None without any."""
    rows = docs.where((fold(id_col, folds) != held_out) & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                own = batch.column(1).filter(pa.array([x == lang for x in langs]))
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for first in range(0, len(own), 64):
                    _, bucket, n = counted(own.slice(first, 64).to_pylist())
                    total += np.bincount(bucket, n, BUCKETS).astype(np.int64)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    found = small_batches(rows).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang: dict[str, np.ndarray] = {}
    for r in found.toLocalIterator():
        by_lang.setdefault(r.lang, np.zeros(BUCKETS))[r.bucket] = r.n
    if not by_lang:
        return None
    languages = sorted(by_lang)
    return Mixture(languages, np.stack([by_lang[x] for x in languages]))


def identify(docs: DataFrame, model: Mixture | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score and languages (the selected ones with their proportions, greatest first) of every row."""
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__spoken"))
    mixes_kind = ArrayType(StructType([StructField("lang", StringType()), StructField("share", DoubleType())]))
    schema = StructType([rows.schema["__id"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("languages", mixes_kind)])
    listed = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def groups(texts: list[str]) -> Iterator[list[str]]:
        group, size = [], 0
        most = 4 * _GROUP // max(4, len(model.languages))
        for t in texts:
            if group and size + len(t) > most:
                yield group
                group, size = [], 0
            group.append(t)
            size += len(t)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                spoken = part.column(2).to_numpy(zero_copy_only=False)
                texts = part.column(1).filter(part.column(2)).to_pylist() if model else []
                langs, scores, mixes = [UNKNOWN] * len(part.column(0)), np.ones(len(spoken)), [[] for _ in spoken]
                if texts:
                    shares = np.concatenate([model.shares(g) for g in groups(texts)])
                    for at, share in zip(np.flatnonzero(spoken).tolist(), shares):
                        order = np.argsort(-share, kind="stable")
                        langs[at], scores[at] = model.languages[order[0]], share[order[0]]
                        mixes[at] = [{"lang": model.languages[k], "share": share[k]} for k in order.tolist() if share[k] > 0]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, listed)], names=schema.names)

    return small_batches(rows).mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def op12_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
