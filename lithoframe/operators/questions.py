"""Questions: their entities, frames, other spellings, translated topics, places, graph scores and rounds.

Dictionaries, areas and names are joined on runs of words, so no text is compared
with all of them.  Patterns are Java patterns, tested without regard to case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.text import collapse, first_reason, translit_key
from lithoframe.operators.dictionary import find_entries, key_words
from lithoframe.plans.scratch import materialize

# The cues of a question's quantifier, polarity and mode; types of
# deposits and stages.
ALL_CUES = r"везде|повсеместн|во\s+всех|всей\s+территори|каждом|throughout|\bevery\b|\ball\s+(?:parts|deposits|areas)"
TYPICAL_CUES = r"характерн|типичн|в\s+целом|обычно|как\s+правило|typical|characteristic|in\s+general"
EXISTS_CUES = r"встречается\s+ли|есть\s+ли|известн\w+\s+ли|где-либо|хотя\s+бы|выявлен\w*\s+ли|\bany\b|\boccur"
NEGATIVE_CUES = r"отсутств|не\s+выявлен|не\s+обнаружен|absence|not\s+found|\bnegative\b"
HYPOTHESIS_CUES = r"гипотез|предполож|модел\w+\s+образован|hypothes|proposed\s+model"
COMPARE_CUES = r"аналог|сравн|похож|analog|compar|similar"
# Russian words and beginnings of words by which the kind of a question is told.
PREPOSITIONS = ("в", "во", "на", "к", "с", "со", "из", "у", "о", "по", "при", "для", "от", "до")
ASKING_ONE = ("какой", "какая", "какое", "какую", "каком", "какого", "каким", "где", "когда", "кто", "сколько", "чем", "чему", "откуда", "куда")
ASKING_MANY = ("какие", "каких", "какими", "какими-либо")
ASKING_OTHER = ("что", "как", "почему", "зачем")
HOLDING = ("содерж", "вмещ", "слага", "образу", "замещ")
BROAD = ("сравн", "различ", "отлич", "механизм", "особенност", "закономерн", "значени", "роль", "роли")
LINKING = ("связ", "ассоци", "сопряж", "сочета", "сопровожд", "сопутств", "контролир")
DEPOSITS = {
    "gold": r"\bgold\b|auriferous|\bau\b|золот\w*|\bau-|-au\b",
    "silver": r"\bsilver\b|\bag\b|серебр\w*",
    "copper": r"\bcopper\b|\bcu\b|медн\w*|\bмед[ьи]\b|cu-",
    "uranium": r"uranium|\bu\b(?=[\s-]*(?:mineral|ore|deposit))|уран\w*",
    "iron": r"iron[\s-]*ore|\bbif\b|banded\s+iron|железоруд\w*|железист\w+\s+кварцит",
    "ree": r"rare[\s-]*earth|\bree\b|рзэ|редкоземел\w*",
    "rare_metal": r"rare[\s-]*metal|редкометал\w*|tantal\w*|niob\w*|lithium|литиев\w*",
    "tin": r"\btin\b|cassiterite|олов\w*|касситерит",
    "tungsten": r"tungsten|wolfram\w*|scheelite|вольфрам\w*|шеелит",
    "base_metals": r"\blead\b|\bzinc\b|\bpb\b|\bzn\b|polymetal\w*|полиметалл\w*|свинц\w*|цинк\w*|колчедан\w*|\bvms\b",
    "fluorite": r"fluorite|флюорит\w*",
    "molybdenum": r"molybden\w*|\bmo\b(?=[\s-]*(?:mineral|ore|deposit|porphyry))|молибден\w*",
    "diamond": r"diamond|кимберлит\w*|алмаз\w*",
    "lithium_brine": r"\bbrine|рассол\w*",
}
STAGE = r"\b((?:early|late|main|first|second|third|pre-|post-|syn-)[\w-]*)\s+(?:stage|phase|event)\b|\b(ранн\w+|поздн\w+|основн\w+|перв\w+|втор\w+|трет\w+)\s+(?:стади\w+|этап\w*|фаз\w+)"


def _has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit("(?iU)" + pattern))


def _key(text: Column) -> Column:
    return F.array_join(key_words(F.lower(text)), " ")


def _beginnings(text: Column) -> Column:
    """The first five letters of each word of four letters or more."""
    return F.transform(F.filter(key_words(F.lower(text)), lambda w: F.length(w) >= 4), lambda w: F.substring(w, 1, 5))


def _begins(word: Column, beginnings: Sequence[str]) -> Column:
    return reduce(lambda p, q: p | q, [F.startswith(word, F.lit(x)) for x in beginnings])


def _followed(words: Column, first: Sequence[str], then: Callable[[Column], Column], reach: int) -> Column:
    """Whether a word of ``first`` has one for which ``then`` holds among the next ``reach``."""
    return F.exists(F.sequence(F.lit(0), F.size(words)), lambda i: F.coalesce(F.get(words, i).isin(*first), F.lit(False)) & F.exists(F.slice(words, i + 2, F.lit(reach)), then))


def is_narrow(question: Column) -> Column:
    """A question for one fact, in Russian.

    It opens with a word that asks for one thing, after a preposition or not, or asks
    which things hold something; it has one question mark at most, no second question
    joined by "and" and no word that asks for a comparison or an account.
    """
    words = key_words(F.lower(question))
    opening = F.when(F.get(words, F.lit(0)).isin(*PREPOSITIONS), F.get(words, F.lit(1))).otherwise(F.get(words, F.lit(0)))
    holds = F.get(words, F.lit(0)).isin(*ASKING_MANY) & F.exists(F.slice(words, 2, 12), lambda w: _begins(w, HOLDING))
    second = _followed(words, ("и", "а", "также"), lambda w: w.isin(*ASKING_ONE, *ASKING_MANY, *ASKING_OTHER), 1)
    broad = second | F.exists(words, lambda w: _begins(w, BROAD))
    return F.coalesce((opening.isin(*ASKING_ONE) | holds) & (F.regexp_count(question, F.lit(r"\?")) <= 1) & ~broad, F.lit(False))


def about_links(question: Column) -> Column:
    """A question for what something is linked with, in Russian: a word that asks, then a word of linking among the next five."""
    words = key_words(F.lower(question))
    return F.coalesce(_followed(words, ("чем", "что", *ASKING_MANY), lambda w: _begins(w, LINKING), 5) | _followed(words, ("где",), lambda w: F.startswith(w, F.lit("встреча")), 1), F.lit(False))


def deposit_types(text: Column, deposits: Mapping[str, str] = DEPOSITS) -> Column:
    """The deposit types that a text names, in the dictionary's order, joined by semicolons; null for none."""
    plain = collapse(text)
    found = F.array_compact(F.array(*[F.when(_has(plain, p), F.lit(name)) for name, p in deposits.items()]))
    return F.nullif(F.array_join(found, ";"), F.lit(""))


def stage(text: Column) -> Column:
    """The stage of mineralisation that a text names, in lower case; null for none."""
    one, two = (F.regexp_extract(collapse(text), "(?iU)" + STAGE, k) for k in (1, 2))
    return F.nullif(F.lower(F.concat(one, two)), F.lit(""))


def resolve_entities(questions: DataFrame, names: DataFrame, *, longest: int = 5) -> DataFrame:
    """(id, entity) of the questions (id, text, hint) that are about an entity of ``names`` (entity, spelling).

    A hint that is a spelling decides.  Otherwise the longest entity that the text
    names by a spelling of four characters or more; with a hint, only if they share
    the beginning of a word.  Ties go to the first by name.
    """
    spelled = names.select("entity", "spelling", _key(F.col("spelling")).alias("key")).where("key <> ''").distinct()
    hinted = questions.select("id", _key(F.col("hint")).alias("key")).join(spelled, "key").select("id", "entity", F.lit(0).alias("rank"))
    met = find_entries(questions, spelled.where(F.length("spelling") >= 4), longest=longest, widest=False).select("id", "entity", "spelling").distinct()
    wanted = questions.select("id", F.coalesce(_beginnings(F.col("hint")), F.array().cast("array<string>")).alias("want"))
    fits = (F.size("want") == 0) | F.arrays_overlap("want", _beginnings(F.col("spelling")))
    named = met.join(wanted, "id").where(fits).select("id", "entity", F.lit(1).alias("rank"))
    return hinted.unionByName(named).groupBy("id").agg(F.min(F.struct("rank", -F.length("entity"), "entity"))["entity"].alias("entity"))


def question_frames(questions: DataFrame, hits: DataFrame, known: DataFrame, deposits: Mapping[str, str] = DEPOSITS) -> DataFrame:
    """id, target, deposits, quantifier, polarity and mode of questions (id, text).

    ``hits`` is what `find_areas` found in them, ``known`` the `area_closure`.  The
    target is the one narrowest area that is named without ambiguity; if there are
    several, there is none.
    """
    sure = hits.groupBy("id", "alias").agg(F.min("area_id").alias("area_id"), F.count_distinct("area_id").alias("n")).where("n = 1").select("id", "area_id").distinct()
    above = sure.join(known.where("area <> ancestor"), F.col("area_id") == F.col("area")).select("id", F.col("ancestor").alias("area_id"))
    narrow = sure.join(above, ["id", "area_id"], "left_anti").groupBy("id").agg(F.min("area_id").alias("target"), F.count("*").alias("n"))
    text = F.col("text")
    return questions.join(narrow.where("n = 1").select("id", "target"), "id", "left").select(
        "id",
        "target",
        deposit_types(text, deposits).alias("deposits"),
        first_reason([("ALL", _has(text, ALL_CUES)), ("TYPICAL", _has(text, TYPICAL_CUES)), ("EXISTS", _has(text, EXISTS_CUES))], "UNSPECIFIED").alias("quantifier"),
        F.when(_has(text, NEGATIVE_CUES), "NEGATE").otherwise("AFFIRM").alias("polarity"),
        first_reason([("RESEARCH_REVIEW", _has(text, HYPOTHESIS_CUES)), ("COMPARATIVE", _has(text, COMPARE_CUES))], "FACTUAL").alias("mode"),
    )


def spelling_variants(queries: DataFrame, spellings: DataFrame, most: int = 6, *, longest: int = 5) -> DataFrame:
    """(id, n, text): each query (id, text) with the other spellings of a name that it has, at most ``most``.

    ``spellings`` has group, ord and spelling; of a group's spellings the first
    that the query holds is replaced where it first stands.  Order is by group and
    ord; equal texts count once.
    """
    s = spellings.select("group", "ord", _key(F.col("spelling")).alias("key")).where("key <> ''")
    held = find_entries(queries, s, longest=longest, widest=False).groupBy("id", "group").agg(F.min(F.struct("ord", "at", "n", "key")).alias("h"))
    others = held.join(s.withColumnRenamed("key", "other"), "group").where(F.col("other") != F.col("h.key"))
    words = queries.select("id", key_words(F.lower("text")).alias("w"))
    cut = lambda a, n: F.call_function("slice", "w", a, n)
    at, n = F.col("h.at"), F.col("h.n")
    text = F.array_join(F.concat(cut(F.lit(1), at), F.array("other"), cut(at + n + 1, F.greatest(F.size("w") - at - n, F.lit(0)))), " ")
    made = others.join(words, "id").select("id", "group", "ord", text.alias("text"), F.array_join("w", " ").alias("was")).where("text <> was")
    first = made.groupBy("id", "text").agg(F.min(F.struct("group", "ord")).alias("o"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("o", "text"))
    return first.withColumn("n", place).where(F.col("n") <= most).select("id", "n", "text")


def translate_topic(topic: str, glossary: Mapping[str, str | Sequence[str]], key: Callable[[str], str] = str) -> str | None:
    """A topic in the glossary's other language: longest phrases first, terms of several words in quotes.

    Words are compared by ``key`` (a stemmer, say).  Latin words stay, other words
    that the glossary lacks go.  None if nothing was translated or fewer than two terms are left.
    """
    terms = {tuple(key(w) for w in re.findall(r"[\w-]+", src.lower())): dst if isinstance(dst, str) else dst[0] for src, dst in glossary.items()}
    widest = max(map(len, terms), default=0)
    words, out, hit, at = re.findall(r"[\w-]+", topic.lower()), [], False, 0
    while at < len(words):
        for n in range(min(widest, len(words) - at), 0, -1):
            if (dst := terms.get(tuple(key(w) for w in words[at : at + n]))) is not None:
                out.append(dst)
                hit, at = True, at + n
                break
        else:
            if re.search("[a-z]", words[at]):
                out.append(words[at])
            at += 1
    out = list(dict.fromkeys(out))
    return " ".join(f'"{t}"' if " " in t else t for t in out) if hit and len(out) > 1 else None


def resolve_place(names: DataFrame, spellings: Sequence[str], *, least: float = 0.85, both: float = 0.6, most: int = 4) -> DataFrame:
    """The ``most`` names (name, and similarity if vectors are at hand) closest to a place's spellings, with score.

    The spellings are one question's, the names are scored where they lie: by the
    ratio of matching runs of their keys, which must reach ``least``, or ``both``
    together with the similarity.
    """
    if not spellings:
        return names.select("name", F.lit(0.0).alias("score")).limit(0)
    asked = [r[0] for r in names.sparkSession.createDataFrame([(s,) for s in spellings], "s string").select(translit_key(F.col("s"))).collect()]

    @F.pandas_udf("double")
    def ratio(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: max(SequenceMatcher(None, a, k).ratio() for a in asked) if k else 0.0)

    near = F.coalesce(F.col("similarity"), F.lit(0.0)) if "similarity" in names.columns else F.lit(0.0)
    scored = names.withColumn("near", near).withColumn("ratio", ratio(translit_key(F.col("name"))))
    close = scored.where((F.col("ratio") >= least) | ((F.col("ratio") >= both) & (F.col("near") >= both)))
    return close.groupBy("name").agg(F.round(F.max(F.col("ratio") + F.col("near")), 6).alias("score")).orderBy(F.desc("score"), "name").limit(most)


def _direct_scores(concepts: DataFrame, facts: DataFrame) -> DataFrame:
    """(question, chunk_id, score): the number of a question's concepts of which a node ends a fact of the chunk.

    Concepts of equal nodes count together, and each counts where the most frequent
    of its nodes stands: that is one weight for each question and node, however
    many concepts share the node.  Only where a concept's other nodes stand without
    that one are its rows made.
    """
    ends = facts.select("chunk_id", F.explode(F.array("src", "dst")).alias("node")).where("node IS NOT NULL")
    times = ends.groupBy("node").agg(F.count("*").alias("times"))
    found = concepts.select("question", "concept", "node").distinct().join(times, "node")
    sets = found.groupBy("question", "concept").agg(F.max_by("node", F.struct("times", "node")).alias("base"), F.array_sort(F.collect_set("node")).alias("nodes"))
    alike = materialize(sets.groupBy("question", "base", "nodes").agg(F.min("concept").alias("concept"), F.count("*").cast("double").alias("w")), "concepts")
    whole = materialize(alike.groupBy(F.col("base").alias("node"), "question").agg(F.sum("w").alias("w")), "weights")
    rest = alike.select("question", "concept", "base", "w", F.explode(F.array_remove("nodes", F.col("base"))).alias("node"))
    blank = [F.lit(None).cast(alike.schema[c].dataType).alias(c) for c in ("question", "concept", "w")]
    at_base = ends.join(whole.select("node").distinct(), "node", "left_semi").select("chunk_id", "node", *blank, F.lit(True).alias("of_base"))
    other = ends.join(rest, "node").select("chunk_id", F.col("base").alias("node"), "question", "concept", "w", F.lit(False).alias("of_base"))
    # all that follows is within a chunk, so one exchange serves it
    rows = at_base.unionByName(other).repartition("chunk_id").distinct()
    kept = rows.withColumn("held", F.max("of_base").over(Window.partitionBy("chunk_id", "node"))).where("of_base OR NOT held")
    weights = whole.select(F.col("node").alias("__node"), F.col("question").alias("__question"), F.col("w").alias("__w"))
    scored = kept.join(weights, F.when(F.col("of_base"), F.col("node")) == F.col("__node"), "left")
    pick = lambda c: F.when(F.col("of_base"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return scored.select(pick("question"), "chunk_id", pick("w")).groupBy("question", "chunk_id").agg(F.sum("w").alias("score"))


def node_scores(concepts: DataFrame, facts: DataFrame, hop: bool = False) -> DataFrame:
    """(question, chunk_id, score): for each concept 1 if a fact of the chunk ends in its nodes, and with ``hop`` 0.5 if one ends only in a neighbour.

    ``concepts`` has question, concept and node, ``facts`` id, chunk_id, src and dst.
    """
    parts = _direct_scores(concepts, facts)
    if hop:
        ends = facts.select("id", "chunk_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
        direct = concepts.join(ends, "node").select("question", "concept", "id").distinct()
        links = facts.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(facts.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()
        around = concepts.join(links, "node").select("question", "concept", F.col("other").alias("node")).distinct()
        near = around.join(ends, "node").select("question", "concept", "id", "chunk_id").distinct().join(direct, ["question", "concept", "id"], "left_anti")
        half = near.select("question", "concept", "chunk_id").distinct().select("question", "chunk_id", F.lit(0.5).alias("score"))
        parts = parts.unionByName(half).groupBy("question", "chunk_id").agg(F.sum("score").alias("score"))
    return parts


def gather_rounds(search: Callable[[Sequence[str]], DataFrame], judge: Callable[[DataFrame], Sequence[str]], queries: Sequence[str], most: int = 3) -> tuple[DataFrame, int]:
    """The hits (id, ...) of up to ``most`` rounds and their number.

    ``judge`` sees what was found so far and names further queries; a round without
    new hits, or nothing new to ask, is the last.
    """
    asked, taken, rounds = set(queries), search(list(queries)).dropDuplicates(["id"]), 1
    while rounds < most:
        further = [q for q in dict.fromkeys(judge(taken)) if q not in asked]
        if not further:
            break
        asked.update(further)
        new = search(further).dropDuplicates(["id"]).join(taken.select("id"), "id", "left_anti")
        rounds += 1
        if new.isEmpty():
            break
        taken = taken.unionByName(new.select(taken.columns))
    return taken, rounds
