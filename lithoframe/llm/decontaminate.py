"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to e = rate * m
edits.  The item is split into e + 1 pieces; whatever the e edits hit, one
piece is left whole, so every occurrence holds an exact piece hit.  One
Aho-Corasick automaton finds the hits of all items' pieces in one pass over a
whole text.  An edit breaks three of an item's trigrams at most, so text around a
hit that lacks more than 3 e of them is left; the rest is verified by Myers'
bit-parallel distance (insertions, deletions and substitutions, free ends in the
text).  So no occurrence within the budget is missed and none beyond it reported.

Items and texts are compared in lower case, with a run of white space as one
space; positions are those of the text.  Pieces have at least ``min_piece``
characters, which bounds e for short items.

The items are the stated query set.  They go to the executors in blocks of at
most `BLOCK_CHARS` characters, one pass over the documents for each block, so
what is sent has a fixed bound however many items there are.

Edge cases: null texts and items are empty; an item without words matches nothing;
an item without an id reports a null one; texts of any length are searched whole;
items with equal text each report; repeated rows each report; a document can
match several items and then has one row for each, with its first best match;
empty tables give an empty table; other input columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lithoframe.llm.common import small_batches, table, text_or_empty

BLOCK_CHARS = 4_000_000
#: Share of an item's characters that may be edited, and the least length of a piece.
RATE, MIN_PIECE = 0.1, 9

_SPACE = re.compile(r"[\t-\r\x1c-\x1f\x85\xa0]")
_RUN = re.compile(r" {2,}")


def normal_form(text: str) -> str:
    """Lower case, white space as spaces; the same length as ``text``."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return _SPACE.sub(" ", low)


def single_spaced(low: str) -> tuple[str, list[tuple[int, int]]]:
    """A normal form with runs of spaces as one, and (place, characters left out before it) after every run."""
    if "  " not in low:
        return low, []
    skipped, gone = [], 0
    for m in _RUN.finditer(low):
        gone += m.end() - m.start() - 1
        skipped.append((m.end() - gone, gone))
    return _RUN.sub(" ", low), skipped


def trigrams(text: str) -> set[str]:
    return {text[k : k + 3] for k in range(len(text) - 2)}


def budget(m: int, rate: float, min_piece: int) -> int:
    return max(0, min(int(rate * m), m // min_piece - 1))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of about equal length with their places."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def bit_masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of ``text``, and where the first such ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, at = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, at = score, j
        up <<= 1
        plus = ((down << 1) | ~(xv | up)) & full
        minus = up & xv & full
    return best, at


class Matcher:
    """Items of one block, ready to be searched for."""

    def __init__(self, items: tuple[tuple[int | None, str], ...], rate: float, min_piece: int):
        self.items = [(i, low) for i, t in items if (low := single_spaced(normal_form(t))[0].strip())]
        self.errors = [budget(len(t), rate, min_piece) for _, t in self.items]
        self.masks = [bit_masks(t) for _, t in self.items]
        self.back = [bit_masks(t[::-1]) for _, t in self.items]
        self.grams = [trigrams(t) for _, t in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for at, piece in pieces(t, self.errors[k]):
                places.setdefault(piece, []).append((k, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def __call__(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item, distance, start, end) of the first best match of every matching item."""
        if not self.any or not text:
            return []
        low, skipped = single_spaced(normal_form(text))
        windows: dict[int, list[list[int]]] = {}
        for last, where in self.automaton.iter(low):
            for k, ends in where:
                begin, e = last + 1 - ends, self.errors[k]
                a, b = max(0, begin - e), begin + len(self.items[k][1]) + e
                own = windows.setdefault(k, [])
                # hits come in order of their ends, so an earlier start can only widen the latest windows
                while own and own[-1][1] >= a:
                    p, q = own.pop()
                    a, b = min(a, p), max(b, q)
                own.append([a, b])
        out = []
        for k, own in windows.items():
            (item, pattern), e = self.items[k], self.errors[k]
            m, best = len(pattern), None
            for a, b in own:
                part = low[a:b]
                if pattern in part:
                    d, end = 0, part.index(pattern) + m
                elif len(self.grams[k] - trigrams(part)) > 3 * e:
                    continue
                else:
                    d, end = myers(self.masks[k], m, part)
                if d <= e and (best is None or d < best[0]):
                    back = myers(self.back[k], m, part[max(0, end - m - e) : end][::-1])[1]
                    best = (d, a + end - back, a + end)
            if best is not None:
                d, start, end = best
                out.append((item, d, self._place(start, skipped), self._place(end - 1, skipped) + 1))
        return out

    @staticmethod
    def _place(at: int, skipped: list[tuple[int, int]]) -> int:
        """Where the character ``at`` of the single-spaced text stands in the text."""
        k = bisect.bisect_right(skipped, at, key=lambda x: x[0])
        return at + (skipped[k - 1][1] if k else 0)


@functools.lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int | None, str], ...], rate: float, min_piece: int) -> Matcher:
    return Matcher(items, rate, min_piece)


def _blocks(items: DataFrame, item_col: str, item_text_col: str) -> Iterator[tuple[tuple[int | None, str], ...]]:
    """The items in blocks of about BLOCK_CHARS characters; at least one block."""
    total = items.select(F.sum(F.length(text_or_empty(item_text_col)))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    keyed = items.select(F.col(item_col).cast("long").alias("i"), text_or_empty(item_text_col).alias("t")).withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    for block in range(blocks):
        yield tuple(sorted(((r.i, r.t) for r in keyed.where(F.col("b") == block).select("i", "t").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])))


def find_leaks(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, min_piece: int = MIN_PIECE
) -> DataFrame:
    """One row per document and item it holds: ids, edit distance, start and end (code points)."""
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField(item_col, LongType()), StructField("distance", IntegerType()), StructField("start", LongType()), StructField("end", LongType())])
    out = None
    for own in _blocks(items, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            match = _matcher(own, rate, min_piece)
            for batch in batches:
                found: list[list] = [[], [], [], [], []]
                for first in range(0, batch.num_rows, 256):
                    for k, text in enumerate(batch.column(1).slice(first, 256).to_pylist(), first):
                        for row in match(text):
                            for column, value in zip(found, (k, *row)):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[0], pa.int64())), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int32()), pa.array(found[3], pa.int64()), pa.array(found[4], pa.int64())], names=schema.names)

        part = small_batches(rows).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, min_piece: int = MIN_PIECE) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts hold no item; no join, no shuffle."""
    at = docs.columns.index(text_col)
    for own in _blocks(items, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            match = _matcher(own, rate, min_piece)
            for batch in batches:
                for first in range(0, batch.num_rows, 256):
                    part = batch.slice(first, 256)
                    yield part.filter(pa.array([not (text and match(text)) for text in part.column(at).to_pylist()], pa.bool_()))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
