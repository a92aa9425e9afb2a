"""Keyword search by an inverted index with phrases, exclusions and spelling variants.

The index has one row for each word and text (word, id, positions) and is meant to
be written partitioned by a hash of the word: a query then reads the rows of its own
words only, whatever the corpus holds.  Scores are documented here and claim no
parity with any other program.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Query:
    """Groups of variants of which each must occur (one of them, if ``any_word``), phrases that must, and words that must not."""

    groups: tuple[tuple[str, ...], ...]
    phrases: tuple[tuple[str, ...], ...] = ()
    excluded: tuple[str, ...] = ()
    any_word: bool = False


def has_syntax(text: str) -> bool:
    """Whether a query uses quotes or a leading minus."""
    return bool(re.search(r'"[^"]+"|(?:^|\s)-\w', text))


def parse(text: str, *, any_word: bool = False, variants: Callable[[str], Sequence[str]] = lambda w: (w,)) -> Query:
    """A query from its text: "a phrase", -excluded, and words with their ``variants``."""
    phrases = [tuple(_TOKEN.findall(p.lower())) for p in re.findall(r'"([^"]+)"', text)] if has_syntax(text) else []
    rest = re.sub(r'"[^"]*"', " ", text.lower())
    excluded = [w for part in re.findall(r"(?:^|\s)-(\S+)", rest) for w in _TOKEN.findall(part)]
    words = _TOKEN.findall(re.sub(r"(?:^|\s)-\S+", " ", rest))
    return Query(tuple(tuple(dict.fromkeys((w, *variants(w)))) for w in dict.fromkeys(words)), tuple(p for p in phrases if p), tuple(dict.fromkeys(excluded)), any_word)


def text_tokens(text: Column) -> Column:
    """The lower-case words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def word_index(df: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``word``, id and the ascending positions of the word in the text.

    A word's positions in one text are gathered, which the text's length bounds.
    """
    each = df.select(F.col(id_col).alias("id"), F.posexplode(text_tokens(F.col(text_col))).alias("at", "word"))
    return each.groupBy("word", "id").agg(F.sort_array(F.collect_list("at")).alias("positions"))


def _phrase(index: DataFrame, phrase: Sequence[str]) -> DataFrame:
    """The texts in which the words follow each other: each word's positions, moved back by its place, must meet."""
    rows = index.where(F.col("word").isin(*phrase))
    starts = [rows.where(F.col("word") == w).select("id", F.explode("positions").alias("at")).select("id", (F.col("at") - k).alias("start"), F.lit(k).alias("k")) for k, w in enumerate(phrase)]
    starts = reduce(lambda a, b: a.unionByName(b), starts)
    return starts.groupBy("id", "start").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(phrase)).select("id").distinct()


def search_index(index: DataFrame, query: Query, k: int) -> DataFrame:
    """The top ``k`` ids with score: the sum over groups of hits / (hits + 1), ties by id.

    A query without words or phrases finds nothing.  An index with a column ``hits``
    is read without its positions, unless there are phrases.
    """
    times = F.col("hits") if "hits" in index.columns else F.size("positions")
    groups = [*query.groups, *[(w,) for p in query.phrases for w in p]]
    if not groups:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    rows = index.where(F.col("word").isin(*{w for g in groups for w in g}))
    hits = [F.sum(F.when(F.col("word").isin(*g), times).otherwise(0)).alias(f"h{i}") for i, g in enumerate(groups)]
    found = rows.groupBy("id").agg(*hits)
    tests = [F.col(f"h{i}") > 0 for i in range(len(groups))]
    free = tests[: len(query.groups)]
    if free:
        found = found.where(reduce(lambda a, b: a | b if query.any_word else a & b, free))
    for phrase in query.phrases:
        found = found.join(_phrase(index, phrase), "id", "left_semi")
    if query.excluded:
        found = found.join(index.where(F.col("word").isin(*query.excluded)).select("id"), "id", "left_anti")
    score = reduce(lambda a, b: a + b, [F.col(f"h{i}") / (F.col(f"h{i}") + F.lit(1.0)) for i in range(len(groups))])
    return found.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def cover_density(index: DataFrame, groups: Sequence[Sequence[str]], k: int) -> DataFrame:
    """The top ``k`` ids whose texts hold a word of every group, by how close together they stand (score, ties by id).

    A cover is a run of words that holds one of every group and no shorter such
    run; it counts 1 / (1 + the words in it beyond one for each group).
    """
    here = [F.when(F.col("word").isin(*g), F.col("at")) for g in groups]
    hits = index.where(F.col("word").isin(*{w for g in groups for w in g})).select("id", "word", F.explode("positions").alias("at"))
    so_far = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = hits.select("id", "at", *[F.last(x, ignorenulls=True).over(so_far).alias(f"l{i}") for i, x in enumerate(here)])
    whole = reduce(Column.__and__, [F.col(f"l{i}").isNotNull() for i in range(len(groups))])
    start = F.least(*[f"l{i}" for i in range(len(groups))]) if len(groups) > 1 else F.col("l0")
    runs = last.where(whole).groupBy("id", start.alias("start")).agg(F.min("at").alias("end"))
    score = F.sum(F.lit(1.0) / (1 + F.greatest(F.col("end") - F.col("start") + 1 - len(groups), F.lit(0))))
    return runs.groupBy("id").agg(F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def clean_name(name: Column) -> Column:
    """A name without surrounding punctuation and a leading preposition or article; inner white space as one space."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"^[\s.,;:!?'\"«»()\[\]-]+|[\s.,;:!?'\"«»(\[-]+$", "")
    return F.regexp_replace(bare, r"(?i)^(?:in|of|at|on|from|the|a|an|в|во|на|из|от)\s+(?=\S)", "")


def clean_relation(relation: Column) -> Column:
    """As `clean_name` without the preposition rule, in lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(relation, r"\s+", " ")), r"^[\s.,;:!?'\"«»()\[\]-]+|[\s.,;:!?'\"«»()\[\]-]+$", ""))


def fact_extras(facts: DataFrame, found: DataFrame, most: int = 2) -> DataFrame:
    """Up to ``most`` further chunks: each with its best fact (similarity, then id), not among the ``found`` chunks."""
    rest = facts.join(found.select("chunk_id").distinct(), "chunk_id", "left_anti")
    best = rest.groupBy("chunk_id").agg(F.max_by(F.struct("id", "similarity"), F.struct("similarity", -F.col("id"))).alias("b"))
    return best.select("chunk_id", "b.id", "b.similarity").orderBy(F.desc("similarity"), "id").limit(most)


def figures_for_answer(figures: DataFrame, per_doc: int = 2, least: float = 0.44) -> DataFrame:
    """At most ``per_doc`` figures of a document: those the answer names first, then by similarity of at least ``least``.

    ``figures`` has doc_id, figure, named and similarity.
    """
    order = Window.partitionBy("doc_id").orderBy(F.desc("named"), F.desc("similarity"), "figure")
    return figures.where(F.col("named") | (F.col("similarity") >= least)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_doc).select("doc_id", "figure", "place")


def cross_document_pairs(hits: DataFrame, most: int = 6) -> DataFrame:
    """The first ``most`` pairs of fragments of different documents among an answer's hits (question, n, doc_id).

    Hits are an answer's sources, a bounded number for each question.
    """
    a, b = hits.alias("a"), hits.alias("b")
    met = a.join(b, (F.col("a.question") == F.col("b.question")) & (F.col("a.n") < F.col("b.n")) & (F.col("a.doc_id") != F.col("b.doc_id")))
    pairs = met.select("a.question", F.col("a.n").alias("first"), F.col("b.n").alias("second"))
    place = F.row_number().over(Window.partitionBy("question").orderBy("first", "second"))
    return pairs.withColumn("place", place).where(F.col("place") <= most)
