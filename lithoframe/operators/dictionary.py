"""Dictionary entries in texts by multi-pattern automata.

A text is reduced to its lower-cased words, one space apart and at both ends, by
built-in functions; an automaton over the keys, with a space at both ends too, then
reads it once, so only whole words match and only hits leave a task.  A dictionary
of at most `BLOCK` characters goes to the tasks with the function.  A larger one is
dealt into blocks of that size, which meet the texts, dealt into parts of about
`PART` characters, by a shuffle; nothing of it passes through the driver.

Edge cases: null texts and texts without words have no hits, nor have keys that are
null, empty or no lower-cased words one space apart; a key of several entries gives
each of them; rows that share an id are texts of their own; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

#: Characters of a dictionary that one automaton is built from; of texts in one part that meets a block.
BLOCK, PART = 1 << 21, 1 << 24
#: Hits in a batch.
BATCH = 1 << 16


def key_words(text: Column) -> Column:
    """The words of a text, as they stand."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _automaton(keys: list[str]) -> ahocorasick.Automaton:
    rows: dict[str, list[int]] = {}
    for i, key in enumerate(keys):
        rows.setdefault(key, []).append(i)
    out = ahocorasick.Automaton()
    for key, at in rows.items():
        out.add_word(f" {key} ", (key.count(" ") + 1, at))
    out.make_automaton()
    return out


def _places(line: str, automaton: ahocorasick.Automaton, widest: bool) -> list[tuple[int, int, list[int]]]:
    """(word, number of words, rows) of the keys in a line, by place, long before short."""
    found = list(automaton.iter(line))
    if not found:
        return []
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
    ends = np.searchsorted(spaces, [end for end, _ in found]).tolist()
    hits = sorted(((end - n, n, rows) for end, (_, (n, rows)) in zip(ends, found)), key=lambda h: (h[0], -h[1]))
    if not widest:
        return hits
    kept, reach = [], 0
    for hit in hits:
        if hit[0] + hit[1] > reach:
            kept.append(hit)
            reach = hit[0] + hit[1]
    return kept


def _hits(texts: pa.RecordBatch, entries: pa.Table, automaton: ahocorasick.Automaton, widest: bool) -> Iterator[pa.RecordBatch]:
    """The columns of ``texts`` but the line, at, n and the columns of ``entries``, for each entry in each line."""
    shown = [c for c in texts.schema.names if c != "__line"]

    def batch() -> pa.RecordBatch:
        of, at, n, row = (pa.array(c, pa.int32()) for c in (text_rows, places, sizes, entry_rows))
        columns = [texts.column(c).take(of) for c in shown] + [at, n] + [entries.column(c).combine_chunks().take(row) for c in entries.column_names]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, [*shown, "at", "n", *entries.column_names])

    text_rows, places, sizes, entry_rows = [], [], [], []
    for i, line in enumerate(texts.column("__line")):
        for at, n, rows in _places(line.as_py(), automaton, widest):
            for row in rows:
                text_rows.append(i), places.append(at), sizes.append(n), entry_rows.append(row)
            if len(entry_rows) >= BATCH:
                yield batch()
                text_rows, places, sizes, entry_rows = [], [], [], []
    if entry_rows:
        yield batch()


@lru_cache(maxsize=1)
def _loaded(block: bytes) -> tuple[pa.Table, ahocorasick.Automaton]:
    """A worker builds the automaton once, not once for each task."""
    entries = pa.ipc.open_stream(block).read_all()
    return entries, _automaton(entries.column("key").to_pylist())


def _by_closure(lines: DataFrame, entries: DataFrame, schema: StructType, widest: bool) -> DataFrame:
    table = entries.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    block = sink.getvalue().to_pybytes()

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton = _loaded(block)
        for texts in batches:
            if len(known):
                yield from _hits(texts, known, automaton, widest)

    return lines.mapInArrow(find, schema)


def _by_blocks(lines: DataFrame, entries: DataFrame, schema: StructType, widest: bool, size: int) -> DataFrame:
    blocks = -(-size // BLOCK)
    total = lines.agg(F.sum(F.length("__line"))).first()[0] or 0
    parts = int(total // PART) + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = F.monotonically_increasing_id()
    texts = lines.withColumn("__row", row).withColumn("__part", F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("int")).withColumn("__block", every(blocks))
    dealt = entries.withColumn("__block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("__part", every(parts))
    columns = entries.columns

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.select(columns)
        shown = left.select(["id", "__row", "__line"]).combine_chunks()
        automaton = _automaton(known.column("key").to_pylist()) if len(known) else None
        found = [b for t in shown.to_batches() for b in _hits(t, known, automaton, widest)] if automaton else []
        return pa.Table.from_batches(found) if found else empty

    whole = StructType([schema["id"], StructField("__row", texts.schema["__row"].dataType), *schema.fields[1:]])
    empty = to_arrow_schema(whole).empty_table()
    hits = texts.groupBy("__part", "__block").cogroup(dealt.groupBy("__part", "__block")).applyInArrow(find, whole)
    if not widest:
        return hits.drop("__row")
    # the hits of a text come from all blocks, so the longest are known only here
    places = hits.groupBy("__row", "at", "n").agg(F.first("id").alias("id"), F.collect_list(F.struct(*columns)).alias("__e"))
    before = Window.partitionBy("__row").orderBy("at", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    reach = places.withColumn("__r", F.max(F.col("at") + F.col("n")).over(before))
    return reach.where(F.col("__r").isNull() | (F.col("at") + F.col("n") > F.col("__r"))).select("id", "at", "n", F.inline("__e"))


def find_entries(texts: DataFrame, entries: DataFrame, *, id_col: str = "id", text_col: str = "text", longest: int = 5, widest: bool = True) -> DataFrame:
    """(id, at, n and the columns of ``entries``) of the entries whose ``key`` stands in a text.

    ``key`` is up to ``longest`` lower-cased words one space apart; ``at`` is the
    number of words before it and ``n`` its own.  With ``widest`` a hit inside
    another one that begins no later is left out.
    """
    line = F.concat(F.lit(" "), F.array_join(key_words(F.lower(text_col)), " "), F.lit(" "))
    lines = texts.select(F.col(id_col).alias("id"), line.alias("__line")).where("__line <> '  '")
    known = entries.where((F.col("key") != "") & (F.size(F.split("key", " ")) <= longest))
    schema = StructType([StructField("id", lines.schema["id"].dataType), StructField("at", IntegerType()), StructField("n", IntegerType()), *(StructField(f.name, f.dataType) for f in known.schema.fields)])
    size = known.agg(F.sum(F.length(F.to_json(F.struct(*known.columns))))).first()[0] or 0
    if size <= BLOCK:
        return _by_closure(lines, known, schema, widest)
    return _by_blocks(lines, known, schema, widest, size)
