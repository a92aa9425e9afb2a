"""Token counts by the whole-token shortcut.

A vocabulary string that the library encodes alone as exactly one token counts
one wherever the pre-tokenizer produces it, because merges never cross a
pre-token.  `prove_whole_tokens` establishes this set once per vocabulary, by
asking the library about every vocabulary string.  Counting then splits a text
into pre-tokens, counts members of the proven set directly, and sends only the
other distinct pre-tokens of a batch through the merges.

The splitting pattern is trusted only for texts made of characters on which the
``regex`` module and the library agree by Unicode version (`_PLAIN`); any other
text, and any text with a special token's string, goes whole to the library.

Edge cases: null text counts as empty (0 bytes, 0 tokens); repeated rows each
give a row; a very long text is counted whole; there are no ties; an empty table gives an empty table; input columns other than the
id and text columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from lithoframe.llm.common import collector_paused, small_batches, table

#: Characters outside this set send a text to the library as a whole.
_PLAIN = regex.compile(r"[^\x09\x0a\x0d\x20-\x7e\xa1-ɏ‐-‧‰-⁞€]")

#: Distinct pre-tokens remembered by a Python worker (about 100 bytes each).
CACHE_ENTRIES = 300_000


def load_tokenizer(path: str):
    """A function from a list of texts to their numbers of tokens, the plain library call."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def prove_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings of a byte-level vocabulary that encode alone as their one token."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    vocab = model.get_vocab(with_added_tokens=False)
    ids = sorted(vocab.values())
    strings = model.decode_batch([[i] for i in ids], skip_special_tokens=False)
    proven = set()
    for start in range(0, len(ids), 4096):
        part = strings[start : start + 4096]
        for i, s, e in zip(ids[start:], part, model.encode_batch_fast(part, add_special_tokens=False)):
            if s and e.ids == [i]:
                proven.add(s)
    return frozenset(proven)


class PretokenCounter:
    """Counts tokens of texts for one vocabulary; made once per Python worker."""

    def __init__(self, path: str, pattern: str | None, whole: frozenset[str], specials: tuple[str, ...]):
        self.encode_counts = load_tokenizer(path)
        self.findall = regex.compile(pattern).findall if pattern else None
        self.whole = whole
        self.specials = specials
        self.known = dict.fromkeys(whole, 1)

    def __call__(self, texts: list[str]) -> list[int]:
        if self.findall is None:
            return self.encode_counts(texts)
        out = [0] * len(texts)
        split: list[tuple[int, list[str]]] = []
        direct: list[int] = []
        for k, text in enumerate(texts):
            if _PLAIN.search(text) or any(s in text for s in self.specials):
                direct.append(k)
            elif text:
                split.append((k, self.findall(text)))
        if direct:
            for k, n in zip(direct, self.encode_counts([texts[k] for k in direct])):
                out[k] = n
        known = self.known
        rest = list({t for _, tokens in split for t in tokens if t not in known})
        if rest:
            if len(known) + len(rest) > CACHE_ENTRIES:
                known = self.known = dict.fromkeys(self.whole, 1)
                rest = list({t for _, tokens in split for t in tokens if t not in known})
            known.update(zip(rest, self.encode_counts(rest)))
        for k, tokens in split:
            out[k] = sum(map(known.__getitem__, tokens))
        return out


@functools.cache
def _counter(path: str, pattern: str | None, specials: tuple[str, ...]) -> PretokenCounter:
    """One counter for all tasks of a Python worker."""
    return PretokenCounter(path, pattern, prove_whole_tokens(path) if pattern else frozenset(), specials)


def _slices(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters, so that long texts do not pile up."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def count_tokens(
    df: DataFrame,
    tokenizer_path: str,
    *,
    pattern: str | None = None,
    specials: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    ``pattern`` is the vocabulary's pre-token pattern (byte-level vocabularies);
    without one, every text goes to the library whole.  ``specials`` are the
    strings the library treats as special tokens inside texts.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path, pattern, specials)
        with collector_paused():
            for batch in batches:
                texts = batch.column(1)
                for start in range(0, len(texts), 512):
                    part = texts.slice(start, 512).to_pylist()
                    n_tokens: list[int] = []
                    for a, b in _slices(part):
                        n_tokens += count(part[a:b])
                    n_bytes = [len(t.encode()) for t in part]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, 512), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                        names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                    )

    return small_batches(rows).mapInArrow(run, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN, specials=("<|endoftext|>",))
