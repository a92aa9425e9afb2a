"""Names in texts: terms, mentions, references, resolution, identity of chunks, votes, typing and scope."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.text import first_reason, jaccard, let, name_key
from lithoframe.operators.dictionary import find_entries, key_words
from lithoframe.plans.scratch import materialize

#: Authors of a document that all its rows carry.
WIDE = 32


def link_terms(texts: DataFrame, terms: DataFrame, *, id_col: str = "id", text_col: str = "text", longest: int = 5) -> DataFrame:
    """(id, at, n, key, term) of dictionary terms in texts.

    ``terms`` has key (lower-cased words) and term.  A hit inside a longer one
    that begins no later is left out, so the longest match wins.
    """
    return find_entries(texts, terms.select("key", "term"), id_col=id_col, text_col=text_col, longest=longest)


def follow(terms: DataFrame, see: DataFrame, hops: int = 2) -> DataFrame:
    """Terms with ``target``, the entry that their "see" references lead to within some hops."""
    out = terms.withColumn("target", F.col("term"))
    for _ in range(hops):
        step = see.select(F.col("term").alias("target"), F.col("see").alias("__to"))
        out = out.join(step, "target", "left").withColumn("target", F.coalesce("__to", "target")).drop("__to")
    return out


def rare_terms(links: DataFrame, total: int, most: float = 0.02) -> DataFrame:
    """Terms that stand in at most a share of all texts."""
    return links.groupBy("term").agg(F.count_distinct("id").alias("texts")).where(F.col("texts") <= most * total)


def distinct_terms_gate(links: DataFrame, least: int = 3) -> DataFrame:
    """Texts with at least some different terms."""
    return links.groupBy("id").agg(F.count_distinct("term").alias("terms")).where(F.col("terms") >= least)


def mentions(name: Column, text: Column) -> Column:
    """True if the text names it whole, or, for names of three words or more, all but one word that is no proper name.

    Words are compared by their stems' keys.
    """
    low = F.lower(text)
    whole = F.contains(F.concat(F.lit(" "), F.array_join(key_words(low), " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(key_words(F.lower(name)), " "), F.lit(" ")))
    have = F.split(name_key(text), " ")
    words = F.filter(key_words(name), lambda w: F.length(w) >= 3)
    missing = let(have, lambda h: F.filter(words, lambda w: ~F.exists(h, lambda x: F.startswith(x, name_key(w)))))
    common = F.forall(missing, lambda w: ~F.rlike(w, F.lit(r"^[\p{Lu}\p{N}]")))
    return whole | ((F.size(words) >= 3) & (F.size(missing) <= 1) & common)


def references(text: Column, kind: str, labels: Column) -> Column:
    """Numbers of figures or formulas that a text names and that exist."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b{kind}[a-z]*\.?\s*\(?(\d+)"), F.lit(1))
    return F.array_sort(F.array_intersect(F.array_distinct(found), labels))


def reference_rows(chunks: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """(doc_id, ord, number, item) for every item a chunk refers to; ``items`` has doc_id, number and item."""
    found = F.regexp_extract_all("text", F.lit(rf"(?i)\b{kind}[a-z]*\.?\s*\(?(\d+)"), F.lit(1))
    return chunks.select("doc_id", "ord", F.explode(F.array_distinct(found)).alias("number")).join(items.select("doc_id", "number", "item"), ["doc_id", "number"])


def match_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, ord, old_id, same): the stored id that each new chunk takes over.

    First chunks of equal text take ids in order of place, then chunks of equal
    place; an id goes to one chunk only.  ``old`` has doc_id, ord, id, text.
    """
    number = lambda d, k: d.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id", k).orderBy("ord")))
    plain = lambda d: d.withColumn("__h", F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256))
    o, n = number(plain(old), "__h"), number(plain(new), "__h")
    by_text = n.join(o.select("doc_id", "__h", "__k", F.col("id").alias("old_id")), ["doc_id", "__h", "__k"], "left").select("doc_id", "ord", "old_id")
    free = old.join(by_text.where("old_id IS NOT NULL").select(F.col("old_id").alias("id")), "id", "left_anti").select("doc_id", "ord", F.col("id").alias("__by_ord"))
    return by_text.join(free, ["doc_id", "ord"], "left").select("doc_id", "ord", F.coalesce("old_id", F.col("__by_ord")).alias("old_id"), F.col("old_id").isNotNull().alias("same"))


def fuzzy_repeat(query: Column, done: Column, least: float = 0.6) -> Column:
    """True if the query shares enough words with any of those already asked."""
    words = lambda c: F.array_distinct(key_words(F.lower(c)))
    return let(words(query), lambda q: F.exists(done, lambda d: jaccard(q, words(d)) >= least))


def author_overlap(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, share): documents that share at least a share of the smaller one's authors.

    ``documents`` has doc_id and authors; names meet by equi-join, never all with all.
    Rows of documents of at most `WIDE` authors carry them, so a pair is decided where it
    meets, and is given at its first shared author only: pairs are neither shuffled nor
    gathered.  Those of wider documents are counted.
    """
    every = F.array_distinct("authors")
    docs = documents.select("doc_id", F.size(every).alias("n"), F.array_sort(F.array_compact(every)).alias("authors"))
    docs = materialize(docs.where(F.size("authors") > 0), "authors")
    side = lambda d, s: d.select(*[F.col(c).alias(f"{s}_{c}") for c in d.columns])
    narrow = docs.where(F.col("n") <= WIDE).select("doc_id", "n", "authors", F.posexplode("authors").alias("at", "author"))
    c = F.col
    fewest = F.least("x_n", "y_n")
    shared = F.size(F.array_intersect("x_authors", "y_authors"))
    need = F.greatest(F.ceil(least * fewest - 1e-9), F.lit(1))
    # the first of at least so many shared authors stands no later in either
    early = (c("x_at") <= F.size("x_authors") - need) & (c("y_at") <= F.size("y_authors") - need)
    first = (c("x_at") == 0) | (c("y_at") == 0) | (F.element_at(F.array_intersect("x_authors", "y_authors"), 1) == c("x_author"))
    met = side(narrow, "x").join(side(narrow, "y"), (c("x_author") == c("y_author")) & (c("x_doc_id") < c("y_doc_id")) & early & ((need == 1) | (shared >= need)) & first)
    pairs = met.select(c("x_doc_id").alias("a"), c("y_doc_id").alias("b"), (F.when(fewest == 1, 1).otherwise(shared) / fewest).alias("share"))
    if docs.where(F.col("n") > WIDE).limit(1).count():
        keyed = docs.select("doc_id", "n", F.explode("authors").alias("author"))
        other = (c("y_n") <= WIDE) | (c("x_doc_id") < c("y_doc_id"))
        met = side(keyed.where(c("n") > WIDE), "x").join(side(keyed, "y"), (c("x_author") == c("y_author")) & (c("x_doc_id") != c("y_doc_id")) & other)
        counted = met.groupBy(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).agg((F.count("*") / F.least(F.max("x_n"), F.max("y_n"))).alias("share"))
        pairs = pairs.unionByName(counted)
    return pairs.where(F.col("share") >= least)


def vote_matches(answer: Column, name: Column, stem: int = 5) -> Column:
    """True if an answer names a thing: half of its words' first letters, or one set inside the other."""
    stems = lambda c: F.array_distinct(F.transform(key_words(F.lower(c)), lambda w: F.substring(w, 1, stem)))
    return let(stems(answer), lambda a: let(stems(name), lambda n: (F.size(n) > 0) & ((F.size(F.array_intersect(a, n)) >= 0.5 * F.size(n)) | ((F.size(a) > 0) & (F.size(F.array_except(a, n)) == 0)))))


def type_relations(facts: DataFrame, schema: DataFrame) -> DataFrame:
    """Facts with rel_type and flip: a relation fits if the kinds of its ends do, in one direction or the other.

    ``schema`` has relation, rel_type, src_kind and dst_kind.
    """
    straight = schema.select("relation", "src_kind", "dst_kind", F.col("rel_type").alias("__t"))
    turned = schema.select("relation", F.col("dst_kind").alias("src_kind"), F.col("src_kind").alias("dst_kind"), F.col("rel_type").alias("__u"))
    out = facts.join(F.broadcast(straight), ["relation", "src_kind", "dst_kind"], "left").join(F.broadcast(turned), ["relation", "src_kind", "dst_kind"], "left")
    return out.select(*facts.columns, F.coalesce("__t", "__u").alias("rel_type"), (F.col("__t").isNull() & F.col("__u").isNotNull()).alias("flip"))


def hedged(relation: Column, quote: Column, cue: str, prefix: str = "presumably ") -> Column:
    """A relation marked as presumed when its quote hedges and it does not."""
    return F.when(F.rlike(F.lower(quote), F.lit(cue)) & ~F.rlike(F.lower(relation), F.lit(cue)), F.concat(F.lit(prefix), relation)).otherwise(relation)


def resolve_scope(claims: DataFrame) -> DataFrame:
    """Areas of a claim from the nearest place that names any: quote, chunk, headings, title.

    Columns quote_areas, chunk_areas, heading_areas and title_areas are arrays;
    adds areas, source and mixed (several areas in one place).
    """
    places = [("EXPLICIT", "quote_areas"), ("ANAPHORA", "chunk_areas"), ("SECTION", "heading_areas"), ("TITLE", "title_areas")]
    source = first_reason([(n, F.size(c) > 0) for n, c in places], "UNKNOWN")
    areas = F.array().cast("array<string>")
    for _, c in reversed(places):
        areas = F.when(F.size(c) > 0, F.array_sort(F.array_distinct(c))).otherwise(areas)
    return claims.withColumns({"areas": areas, "source": source, "mixed": F.size(areas) > 1})


def bind_objects(sentences: DataFrame, sources: DataFrame) -> DataFrame:
    """Sentences without those that name an asked object which none of their cited sources names.

    ``sentences`` has id, n, object (null if it names none) and cited (array);
    ``sources`` has cited and object.
    """
    named = sentences.where("object IS NOT NULL").select("id", "n", "object", F.explode("cited").alias("cited"))
    held = named.join(sources.select("cited", "object").distinct(), ["cited", "object"], "left_semi").select("id", "n").distinct().withColumn("__ok", F.lit(True))
    return sentences.join(held, ["id", "n"], "left").where(F.col("object").isNull() | F.col("__ok")).drop("__ok")


def merge_guard(a: Column, b: Column) -> Column:
    """True if two names may be one: same numbers, Greek letters and compass words."""
    marks = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|[α-ω]|\b(?:north|south|east|west|upper|lower)\w*)"), F.lit(1))))
    return marks(a) == marks(b)


def map_model(df: DataFrame, model: Callable[[list[str]], list[str]], *, id_col: str = "id", text_col: str = "text", batch: int = 8, fallback: Column | None = None) -> DataFrame:
    """(id, answer) of a user's model over batches of texts; a failed batch, or a missing answer, takes the fallback."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), (fallback if fallback is not None else F.lit(None)).cast("string").alias("f"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                try:
                    answers = list(model(part["t"].tolist()))
                except Exception:  # noqa: BLE001  a user's model may fail in any way; its batch then takes the fallback
                    answers = []
                answers += [None] * (len(part) - len(answers))
                yield pd.DataFrame({"id": part["id"], "answer": [a if a is not None else b for a, b in zip(answers, part["f"])]})

    return rows.mapInPandas(run, f"id {kind}, answer string")


def embedder(encode: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 32):
    """A user's encoder as an Arrow UDF from texts to vectors; null texts stay null."""
    from pyspark.sql.types import ArrayType, DoubleType

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(text: pd.Series) -> pd.Series:
        out: list = [None] * len(text)
        known = [k for k, t in enumerate(text) if t is not None]
        for at in range(0, len(known), batch):
            part = known[at : at + batch]
            for k, v in zip(part, encode([text.iloc[k] for k in part])):
                out[k] = [float(x) for x in v]
        return pd.Series(out)

    return run
