"""Model answers and page layout: checked facts and quoted items, extraction, JSON rules, joined paragraphs, headings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.text import collapse, first_reason, let, name_key, name_problem
from lithoframe.operators.dictionary import key_words
from lithoframe.operators.linking import mentions
from lithoframe.operators.upkeep import rejection_notes, save_facts
from lithoframe.operators.words import clean_name, clean_relation

_CYRILLIC = "[А-Яа-яЁё]"


def checked_facts(rows: DataFrame, chunks: DataFrame, *, read: int = 40, most: int = 20, back: int = 1) -> tuple[DataFrame, DataFrame]:
    """A model's rows (chunk_id, ord, n, src, relation, dst) as checked facts, and the rejected ones with their reason.

    ``chunks`` has chunk_id and sents, its sentences.  ``n`` is the number of a
    sentence, from 1; the quote is that sentence, with the next one, or with up to
    ``back`` before, the first of these that names both ends.  The first ``read``
    rows of a chunk are looked at, and the first ``most`` different facts are kept.
    """
    order = Window.partitionBy("chunk_id").orderBy("ord")
    seen = rows.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= read)
    number = F.regexp_extract(F.col("n").cast("string"), r"^\s*\[?\s*(\d{1,9})", 1)
    seen = seen.select("chunk_id", "ord", F.when(number != "", number.cast("int")).alias("n"), clean_name(F.col("src")).alias("src"), clean_relation(F.col("relation")).alias("relation"), clean_name(F.col("dst")).alias("dst"))
    n, s = F.col("n"), F.col("sents")
    inside = F.coalesce(n.between(1, F.size(s)), F.lit(False))
    first, last = lambda k: F.greatest(n - k, F.lit(1)), lambda e: F.least(n + e, F.size(s))
    spans = [F.when(F.col("inside"), F.array_join(F.call_function("slice", s, first(k), last(e) - first(k) + 1), " ")) for k in range(back + 1) for e in (0, 1)]
    both = seen.join(chunks.select("chunk_id", "sents"), "chunk_id").withColumn("inside", inside).withColumn("spans", F.array(*spans)).drop("sents")
    quotes = [F.get("spans", F.lit(i)) for i in range(len(spans))]
    named = both.withColumn("quote", F.coalesce(*[F.when(mentions(F.col("src"), q) & mentions(F.col("dst"), q), q) for q in quotes])).drop("spans")
    half = lambda c: F.rlike(c, F.lit(_CYRILLIC)) & ~F.rlike("quote", F.lit(_CYRILLIC))
    words = F.size(key_words(F.col("relation")))
    rules = [("relation", ~words.between(1, 6)), ("self", name_key(F.col("src")) == name_key(F.col("dst"))), ("no sentence", ~F.col("inside")), ("not in quote", F.col("quote").isNull()), ("half translated", half("src") | half("dst"))]
    marked = named.withColumn("reason", F.coalesce(name_problem(F.col("src")), name_problem(F.col("dst")), first_reason(rules)))
    keys = [name_key(F.col("src")).alias("src_key"), F.col("relation"), name_key(F.col("dst")).alias("dst_key")]
    kept = marked.where("reason IS NULL").groupBy("chunk_id", *keys).agg(F.min(F.struct("ord", "src", "dst", "quote")).alias("f"))
    kept = kept.withColumn("__at", F.row_number().over(Window.partitionBy("chunk_id").orderBy("f.ord"))).where(F.col("__at") <= most)
    return kept.select("chunk_id", "f.ord", "f.src", "relation", "f.dst", "f.quote"), marked.where("reason IS NOT NULL").select("chunk_id", "ord", "reason")


def extract_facts(chunks: DataFrame, done: DataFrame, facts: DataFrame, wanted: Column, model: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One resumable pass: the facts after it, and a note (chunk_id, n, reasons) for each chunk with rejected rows.

    Chunks that are not in ``done`` and are ``wanted`` go through ``model``, which
    gives the rows that `checked_facts` reads; what passes replaces the chunk's
    facts (id, chunk_id, src, relation, dst).  A new fact's id is a hash of its
    chunk and place, so a repeated pass gives the same ids.
    """
    todo = chunks.where(wanted).join(done.select("chunk_id"), "chunk_id", "left_anti")
    kept, rejected = checked_facts(model(todo), todo)
    new = kept.select(F.xxhash64("chunk_id", "ord").alias("id"), "chunk_id", "src", "relation", "dst")
    return save_facts(facts, new, todo.select("chunk_id")), rejection_notes(rejected)


def checked_items(items: DataFrame, chunks: DataFrame, subjects: Sequence[str], near: int = 300) -> DataFrame:
    """A model's items (doc_id, ord, what, quote, fragment) that hold, as doc_id, ord, what and chunk_id.

    The quote must stand, up to white space and case, in the named fragment, or, if
    the document (doc_id, chunk_id, text) has none of that number, in one of its
    chunks, the first by number; a subject's name must stand in it or ``near``
    characters around; the item must be named in the quote and be no subject itself.
    """
    plain = lambda c: F.lower(collapse(F.col(c)))
    have = chunks.select("doc_id", "chunk_id", plain("text").alias("__t"))
    asked = items.select("doc_id", "ord", F.trim("what").alias("what"), plain("quote").alias("__q"), "fragment").where("what <> '' AND __q <> ''")
    own = asked.join(have.select("doc_id", F.col("chunk_id").alias("fragment")).distinct().withColumn("__own", F.lit(True)), ["doc_id", "fragment"], "left")
    met = own.join(have, "doc_id").where(F.col("__own").isNull() | (F.col("chunk_id") == F.col("fragment")))
    found = met.withColumn("__at", F.instr(F.col("__t"), F.col("__q"))).where("__at > 0")
    found = found.groupBy("doc_id", "ord", "what", "__q").agg(F.min(F.struct("chunk_id", "__at", "__t")).alias("c"))
    start = F.greatest(F.col("c.__at") - near, F.lit(1))
    window = F.substring(F.col("c.__t"), start, F.col("c.__at") - start + F.length("__q") + near)
    tests = mentions(F.col("what"), F.col("__q"))
    if subjects:
        about = F.lit(False)
        for name in subjects:
            about = about | mentions(F.lit(name), window)
            tests = tests & (name_key(F.col("what")) != name_key(F.lit(name)))
        tests = tests & about
    return found.where(tests).select("doc_id", "ord", "what", F.col("c.chunk_id").alias("chunk_id"))


_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(?:BIGINT|DECIMAL.*|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "null": "VOID", "object": "OBJECT.*", "array": "ARRAY.*"}


def json_problems(text: Column, schema: Mapping) -> Column:
    """Where a JSON text breaks a schema: an array of ``path: rule``, empty if it holds, in the schema's order.

    Known are type, required, properties, additionalProperties (false), enum,
    minimum, maximum, minLength, maxLength and pattern, of nested objects too.
    """

    def problems(value: Column) -> Column:
        tests: list[tuple[Column, str]] = [(value.isNull(), "$: json")]

        def walk(path: str, rules: Mapping, there: Column) -> None:
            get = lambda kind: F.try_variant_get(value, path, kind)
            kind = F.schema_of_variant(get("variant"))
            if "type" in rules:
                names = [rules["type"]] if isinstance(rules["type"], str) else rules["type"]
                tests.append((there & ~F.rlike(kind, F.lit("^(?:" + "|".join(_TYPES[n] for n in names) + ")$")), f"{path}: type"))
            if "enum" in rules:
                tests.append((there & ~F.coalesce(get("string").isin(*[str(x) for x in rules["enum"]]), F.lit(False)), f"{path}: enum"))
            number, length = get("double"), F.length(get("string"))
            is_text = F.coalesce(kind == "STRING", F.lit(False))
            for name, test in (("minimum", lambda x: ~is_text & (number < x)), ("maximum", lambda x: ~is_text & (number > x)), ("minLength", lambda x: is_text & (length < x)), ("maxLength", lambda x: is_text & (length > x)), ("pattern", lambda x: is_text & ~F.rlike(get("string"), F.lit(x)))):
                if name in rules:
                    tests.append((there & test(rules[name]), f"{path}: {name}"))
            inner, is_object = rules.get("properties", {}), F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))
            for name in rules.get("required", ()):
                tests.append((is_object & F.try_variant_get(value, f"{path}.{name}", "variant").isNull(), f"{path}.{name}: required"))
            if rules.get("additionalProperties") is False:
                keys = F.map_keys(get("map<string,variant>"))
                tests.append((is_object & (F.size(F.array_except(keys, F.array(*map(F.lit, inner)).cast("array<string>"))) > 0), f"{path}: additionalProperties"))
            for name, below in inner.items():
                walk(f"{path}.{name}", below, F.try_variant_get(value, f"{path}.{name}", "variant").isNotNull())

        walk("$", schema, value.isNotNull())
        return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for t, name in tests]))

    return let(F.try_parse_json(text), problems)


def yaml_items(columns: Mapping[str, Column]) -> Column:
    """A row as one item of a YAML list: numbers bare, texts quoted as in JSON, nulls as null."""
    lines = []
    for k, (name, c) in enumerate(columns.items()):
        quoted = F.substring(F.to_json(F.array(c.cast("string"))), F.lit(2), F.length(F.to_json(F.array(c.cast("string")))) - 2)
        bare = F.rlike(c.cast("string"), F.lit(r"^-?\d+(?:\.\d+)?$"))
        lines.append(F.concat(F.lit(("- " if k == 0 else "  ") + name + ": "), F.when(c.isNull(), F.lit("null")).when(bare, c.cast("string")).otherwise(quoted)))
    return F.array_join(F.array(*lines), "\n")


def join_paragraphs(parts: DataFrame, *, through: Sequence[str] = ("picture", "table", "caption", "footnote", "chart"), prose: Sequence[str] = ("text", "paragraph", "list_item")) -> DataFrame:
    """(doc_id, ord, text, pieces): paragraphs that pages or columns cut, whole again.

    ``parts`` has doc_id, ord, label and text.  A paragraph that begins with a small
    letter continues the prose before it unless that ends a sentence; what lies
    between them and is in ``through`` does not part them.  Other parts stay apart.
    """
    rows = parts.where(~F.col("label").isin(*through))
    order = Window.partitionBy("doc_id").orderBy("ord")
    before, kind = F.lag("text").over(order), F.lag("label").over(order)
    open_end = kind.isin(*prose) & (before != "") & ~F.rlike(before, F.lit(r"[.!?:;…]\s*$"))
    goes_on = F.coalesce(open_end & F.col("label").isin("text", "paragraph") & F.rlike("text", F.lit(r"^\s*[a-zа-яё]")), F.lit(False))
    marked = rows.withColumn("__new", (~goes_on).cast("int"))
    grouped = marked.withColumn("__g", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    whole = grouped.groupBy("doc_id", "__g").agg(F.min("ord").alias("ord"), pieces.alias("p"))
    left = lambda t, i: F.when(i > 0, F.regexp_replace(t, r"^\s+", "")).otherwise(t)
    both = lambda t, i: F.when(i < F.size("p") - 1, F.regexp_replace(left(t, i), r"\s+$", "")).otherwise(left(t, i))
    trimmed = F.transform("p", both)
    return whole.select("doc_id", "ord", F.array_join(trimmed, " ").alias("text"), F.size("p").alias("pieces"))


def page_sections(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", most: int = 300) -> DataFrame:
    """(id, ord, level, title) of a page's headings of the first four levels with under ``most`` characters."""
    pattern = F.lit(r"(?is)<h([1-4])\b[^>]*>(.*?)</h[1-4]\s*>")
    found = F.arrays_zip(F.regexp_extract_all(html_col, pattern, F.lit(1)).alias("level"), F.regexp_extract_all(html_col, pattern, F.lit(2)).alias("title"))
    each = pages.select(id_col, F.posexplode(found).alias("ord", "h"))
    title = collapse(F.regexp_replace(F.regexp_replace("h.title", "<[^>]*>", " "), "&[#a-zA-Z0-9]+;", " "))
    return each.select(id_col, "ord", F.col("h.level").cast("int").alias("level"), title.alias("title")).where((F.col("title") != "") & (F.length("title") < most))
