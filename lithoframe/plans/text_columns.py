"""Queries of the text columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lithoframe.functions import text as X
from lithoframe.operators import search as S
from lithoframe.plans.catalog import query
from lithoframe.plans.views import CHUNKS, chunks, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x{00a0}]+', ' ', 'g')) AS text FROM documents")
def collapsed_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.collapse(F.col("text")).alias("text"))


@query(r"SELECT doc_id, CASE WHEN length(t) = 0 THEN 'en' WHEN least(c, l) / greatest(c + l, 1) >= 0.3 THEN 'mixed' WHEN c > l THEN 'ru' ELSE 'en' END AS letters FROM (SELECT doc_id, text AS t, len(regexp_extract_all(lower(text), '[а-яё]')) AS c, len(regexp_extract_all(lower(text), '[a-z]')) AS l FROM documents)")
def language_mix(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.language(F.col("text")).alias("letters"))


@query(
    r"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 1.0 ELSE round((odd + 2 * broken + cid) / greatest(length(clean), 1), 4) END AS garbage FROM (
SELECT doc_id, text, clean, len(regexp_extract_all(text, '\(cid:\d+\)')) AS cid, len(regexp_extract_all(clean, '[^\p{L}\p{M}\p{N}\p{P}\s$+<=>^`|~]')) AS odd, len(regexp_extract_all(clean, '[\x{00c3}\x{00d0}\x{00d1}][\x{0080}-\x{00bf}]')) AS broken
FROM (SELECT doc_id, text, regexp_replace(text, '\(cid:\d+\)', '', 'g') AS clean FROM documents))"""
)
def garbage_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.garbage_ratio(F.col("text")).alias("garbage"))


@query(r"SELECT doc_id, line, n FROM (SELECT doc_id, line, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, line) AS rn FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE length(line) > 20 GROUP BY doc_id, line) WHERE rn = 1")
def repeated_lines(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("length(line) > 20")
    return S.top_per_group(lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")), "doc_id", [F.desc("n"), F.col("line")], 1).select("doc_id", "line", "n")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[#a-zA-Z0-9]+;', ' ', 'g'), '[\s\x{00a0}]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))


@query(r"SELECT page_id, lower(trim(regexp_replace('https://doi.org/10.1000/' || url, '^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', '', 'i'))) AS doi, regexp_replace(lower(url), '[^a-z0-9._-]+', '_', 'g') AS slug FROM pages")
def doi_and_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.doi(F.concat(F.lit("https://doi.org/10.1000/"), "url")).alias("doi"), X.slug(F.col("url")).alias("slug"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, sha256(html) AS sha256, octet_length(encode(html)) AS bytes FROM pages")
def fetched_pages(spark, sf_dir):
    """Title, language, hash and size of fetched bytes."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))


@query(r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(\d{4})', 1), '') AS INTEGER) AS any_year, CASE WHEN TRY_CAST(nullif(regexp_extract(text, '(\d{4})', 1), '') AS INTEGER) BETWEEN 1800 AND 2100 THEN TRY_CAST(nullif(regexp_extract(text, '(\d{4})', 1), '') AS INTEGER) END AS year FROM documents")
def year_extraction(spark, sf_dir):
    found = F.regexp_extract("text", r"(\d{4})", 1)
    return _docs(spark, sf_dir).select("doc_id", F.when(found != "", found.cast("int")).alias("any_year"), X.year(F.col("text")).alias("year"))


_STEM = r"""CASE WHEN regexp_matches(w, '^.{4,}ies$') THEN regexp_replace(w, 'ies$', '') WHEN regexp_matches(w, '(sses|xes|ches|shes)$') THEN regexp_replace(w, 'es$', '')
 ELSE CASE WHEN regexp_matches(s, '^.{3,}[^aeiou]y$') THEN regexp_replace(s, 'y$', '') ELSE s END END"""


@query(rf"SELECT w AS word, {_STEM} AS stem, n FROM (SELECT *, CASE WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, '(ss|us|is)$') THEN regexp_replace(w, 's$', '') ELSE w END AS s FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part) GROUP BY w))")
def english_stems(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", X.en_stem(F.col("word")).alias("stem"), "n")


@query(
    r"""SELECT key, count(*) AS names FROM (SELECT p_partkey, string_agg(CASE WHEN regexp_matches(w, '^.{3,}s$') AND NOT regexp_matches(w, 'ss$') THEN CASE WHEN regexp_matches(w, '(sses|xes|ches|shes)$') THEN regexp_replace(w, 'es$', '') ELSE regexp_replace(w, 's$', '') END ELSE w END, ' ' ORDER BY k) AS key
FROM (SELECT p_partkey, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM (SELECT p_partkey, regexp_extract_all(replace(lower(p_name), '-', ' '), '[a-zа-я0-9α-ω]+') AS ws FROM part)) GROUP BY p_partkey) GROUP BY key"""
)
def name_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select(X.name_key(F.col("p_name")).alias("key")).groupBy("key").agg(F.count("*").alias("names"))


_KEY = "lower(n_name)"
for _p, _t in (("shch|sch", "sh"), ("kh", "h"), ("dzh|dj|zh", "j"), ("ph", "f"), ("th", "t"), ("gh", "g"), ("ck", "k"), ("qu", "kv"), ("q", "k"), ("w", "v"), ("x", "ks"), ("ou", "u"), ("ch", "\x01"), ("c", "k"), ("\x01", "ch"), ("y([aeou])", r"\1"), ("y", "i"), ("[^a-z]", "")):
    _KEY = f"regexp_replace({_KEY}, '{_p}', '{_t}', 'g')"
for _c in "abcdefghijklmnopqrstuvwxyz":
    _KEY = f"regexp_replace({_KEY}, '{_c}+', '{_c}', 'g')"


@query(f"SELECT n_nationkey, {_KEY} AS key FROM nation")
def translit_keys(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", X.translit_key(F.col("n_name")).alias("key"))


@query(r"SELECT doc_id, array_to_string(list_transform(list_distinct(flatten(list_transform(regexp_extract_all(t, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: list_transform(string_split(replace(g, ' ', ''), ','), lambda x: CAST(x AS INTEGER))))).list_sort(), lambda x: CAST(x AS VARCHAR)), ',') AS cited FROM (SELECT doc_id, text || ' [' || (doc_id % 9) || ', ' || (doc_id % 4) || '] and [' || (doc_id % 9) || ']' AS t FROM documents)")
def citation_numbers(spark, sf_dir):
    number = lambda n: (F.col("doc_id") % n).cast("string")
    t = F.concat("text", F.lit(" ["), number(9), F.lit(", "), number(4), F.lit("] and ["), number(9), F.lit("]"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.sort_array(X.citations(t)), lambda x: x.cast("string")), ",").alias("cited"))


@query(rf"WITH {CHUNKS} SELECT doc_id, ord, length(text) >= 200 AND len(regexp_extract_all(text, '\(\d{{4}}\)|\[\d+\]|et al|doi')) * 1000.0 / length(text) >= 0.5 AS is_list FROM chunks WHERE length(text) > 0")
def reference_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).where("length(text) > 0").select("doc_id", "ord", X.is_reference_list(F.col("text"), 0.5).alias("is_list"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)?'), lambda x: replace(x, ',', '.')), lambda x: length(replace(x, '.', '')) >= 2))), ' ') AS numbers FROM documents")
def significant_numbers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.sort_array(X.numbers(F.col("text"))), " ").alias("numbers"))


@query(r"SELECT a.p_partkey, a.p_size < b.p_size * 0.97 / 1.03 OR a.p_size * 0.97 / 1.03 > b.p_size AS clash FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def numeric_clash(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("t"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"))
    return p.join(b, "p_partkey").select("p_partkey", X.ranges_clash(X.ranges(F.col("t")), X.ranges(F.col("u"))).alias("clash"))


_SHINGLES = r"list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' ')) ELSE [] END)"


@query(
    rf"""WITH s AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents))
SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(a.s, b.s))) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END, 6) AS jaccard FROM s a JOIN s b ON b.doc_id = a.doc_id + 1"""
)
def shingle_jaccard(spark, sf_dir):
    s = _docs(spark, sf_dir).select("doc_id", X.shingles(F.col("text")).alias("s"))
    after = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return s.join(after, "doc_id").select("doc_id", F.round(X.jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"))


@query(r"SELECT conv_id, turn, regexp_matches(trim(text), '^(?:\p{Ll}|(?:This|These|Such|However|Therefore|It)\b)') AS starts, NOT regexp_matches(trim(text), '[.!?…»\x22”)]$') AS ends FROM conversations")
def mid_thought(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", X.starts_mid_thought(F.col("text")).alias("starts"), X.ends_mid_thought(F.col("text")).alias("ends"))


@query(
    r"""SELECT word, reason FROM (SELECT DISTINCT w AS word, CASE WHEN l = '' THEN 'empty' WHEN length(l) > 80 THEN 'long' WHEN regexp_matches(l, '^[\d\s.,%±~-]+$') THEN 'number' WHEN regexp_matches(l, '^[\d.,]+\s*(?:%|km|m|cm|mm|t|kg|g|ppm|ma|ga)\b') THEN 'quantity'
WHEN regexp_matches(l, '\bet al\b|\[\d+\]') THEN 'citation' WHEN l IN ('it', 'this', 'they', 'these', 'that', 'he', 'she', 'we') THEN 'pronoun' WHEN regexp_matches(l, '^(?:1[89]|20)\d\d$') THEN 'year' WHEN regexp_matches(l, '^(?:one|two|three|four|five|several|many|some)\s') THEN 'counted'
WHEN regexp_matches(l, '^(?:north|south|east|west|centre|center|upper|lower)\w*(?:\s+part)?$') THEN 'position' WHEN l IN ('area', 'region', 'zone', 'deposit', 'rock', 'rocks', 'part', 'data', 'study') THEN 'generic' END AS reason
FROM (SELECT w, lower(trim(w)) AS l FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents))) WHERE reason IS NOT NULL"""
)
def rejected_names(spark, sf_dir):
    words = _docs(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", X.name_problem(F.col("word")).alias("reason")).where("reason IS NOT NULL")


@query(r"SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, coalesce(nullif(json_extract_string(props, '$.name'), ''), nullif(json_extract_string(props, '$.k'), '')) AS first_found FROM events")
def json_paths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), X.json_pick(F.col("props"), "name|k").alias("first_found"))


@query("SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), lower(n_name)) THEN c_mktsegment ELSE c_mktsegment || ' (' || n_name || ')' END AS title, 'D:' || substr(sha256(c_custkey || '|' || n_name), 1, 16) AS decision_id FROM customer JOIN nation ON n_nationkey = c_nationkey")
def titles_and_ids(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", X.title_with_place(F.col("c_mktsegment"), F.col("n_name")).alias("title"), F.concat(F.lit("D:"), F.substring(F.sha2(F.concat_ws("|", "c_custkey", "n_name"), 256), 1, 16)).alias("decision_id"))


@query(
    rf"""WITH {CHUNKS}, marked AS (SELECT doc_id, ord, CASE WHEN regexp_matches(text, '^(?:Fig|Figure|Table|Tab)\.?\s*\d') THEN 'CAPTION' WHEN len(regexp_extract_all(text, '\|')) >= 2 OR regexp_matches(text, '^[\d\s.,;-]+$') THEN 'TABLE_ROW' WHEN regexp_matches(text, '^\S+\s+[-–=]\s+\S+(?:;|$)') THEN 'LEGEND' ELSE 'PROSE' END AS kind, n_chars FROM chunks)
SELECT doc_id, CAST(sum(n_chars) FILTER (WHERE kind = 'PROSE') AS BIGINT) AS prose, CAST(sum(n_chars) FILTER (WHERE kind <> 'PROSE') AS BIGINT) AS other, coalesce(sum(n_chars) FILTER (WHERE kind IN ('PROSE', 'TABLE_ROW')), 0) <= 0.3 * sum(n_chars) AS skip FROM marked GROUP BY doc_id"""
)
def caption_skip(spark, sf_dir):
    t = F.col("text")
    kind = X.first_reason([("CAPTION", F.rlike(t, F.lit(r"^(?:Fig|Figure|Table|Tab)\.?\s*\d"))), ("TABLE_ROW", (F.regexp_count(t, F.lit(r"\|")) >= 2) | F.rlike(t, F.lit(r"^[\d\s.,;-]+$"))), ("LEGEND", F.rlike(t, F.lit(r"^\S+\s+[-–=]\s+\S+(?:;|$)")))], "PROSE")
    marked = chunks(spark, sf_dir).select("doc_id", "n_chars", kind.alias("kind"))
    chars = lambda test: F.sum(F.when(test, F.col("n_chars")))
    return marked.groupBy("doc_id").agg(chars(F.col("kind") == "PROSE").alias("prose"), chars(F.col("kind") != "PROSE").alias("other"), (F.coalesce(chars(F.col("kind").isin("PROSE", "TABLE_ROW")), F.lit(0)) <= F.lit(0.3) * F.sum("n_chars")).alias("skip"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents)),
g AS (SELECT doc_id, array_to_string([w, lead(w, 1) OVER x, lead(w, 2) OVER x, lead(w, 3) OVER x, lead(w, 4) OVER x, lead(w, 5) OVER x], ' ') AS gram, k, n FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, count(*) AS runs FROM (SELECT doc_id, gram FROM g WHERE k <= n - 6 GROUP BY doc_id, gram HAVING count(*) >= 3) GROUP BY doc_id"""
)
def running_lines(spark, sf_dir):
    """Documents whose six-word runs come back three times or more: running heads and boilerplate."""
    grams = _docs(spark, sf_dir).select("doc_id", S.tokens(F.col("text")).alias("w"))
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 6), lambda i: F.array_join(F.slice(w, i + 1, 6), " "))
    each = grams.where(F.size("w") >= 6).select("doc_id", F.explode(X.let(F.col("w"), runs)).alias("gram"))
    return each.groupBy("doc_id", "gram").count().where("count >= 3").groupBy("doc_id").agg(F.count("*").alias("runs"))


@query(
    r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '^(?:and|also|und|et|y)\b') OR length(text) < 40 THEN 'follow_up' WHEN regexp_matches(text, '\?') THEN 'question' ELSE 'statement' END AS intent, CAST(ceil(length(text) / 3) AS BIGINT) AS tokens,
CAST(sum(ceil(length(text) / 3)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS from_end FROM conversations"""
)
def conversation_budget(spark, sf_dir):
    """Intent of every turn and the running token estimate from the newest turn back."""
    t = F.col("text")
    intent = X.first_reason([("follow_up", F.rlike(F.lower(t), F.lit(r"^(?:and|also|und|et|y)\b")) | (F.length(t) < 40)), ("question", F.contains(t, F.lit("?")))], "statement")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", intent.alias("intent"), X.token_estimate(t).alias("tokens"), F.sum(X.token_estimate(t)).over(w).alias("from_end"))


@query(
    r"""SELECT doc_id, round((CAST(contains(t, ' the ') AS INTEGER) * 1.0 + CAST(contains(t, ' of ') AS INTEGER) * 1.0 + CAST(contains(t, ' der ') AS INTEGER) * 2.0) / 4.0 + CASE WHEN contains(source, 'src1') THEN 0.25 ELSE 0 END, 4) AS score, (CAST(contains(t, ' the ') AS INTEGER) * 1.0 + CAST(contains(t, ' of ') AS INTEGER) * 1.0 + CAST(contains(t, ' der ') AS INTEGER) * 2.0) / 4.0 + CASE WHEN contains(source, 'src1') THEN 0.25 ELSE 0 END >= CASE WHEN n_chars < 500 THEN 0.3 ELSE 0.5 END AS relevant
FROM (SELECT *, lower(text) AS t FROM documents)"""
)
def relevance_score(spark, sf_dir):
    """Weighted share of terms with a title bonus; short texts have a lower threshold."""
    low = F.lower("text")
    share = sum((F.contains(low, F.lit(f" {w} ")).cast("int") * v for w, v in (("the", 1.0), ("of", 1.0), ("der", 2.0))), F.lit(0.0)) / 4.0
    score = share + F.when(F.contains("source", F.lit("src1")), 0.25).otherwise(0.0)
    return _docs(spark, sf_dir).select("doc_id", F.round(score, 4).alias("score"), (score >= F.when(F.col("n_chars") < 500, 0.3).otherwise(0.5)).alias("relevant"))


@query(r"SELECT doc_id, n_chars >= 100 AS long_enough, len(string_split(text, chr(10))) <= 400 AS few_lines, n_chars >= 100 AND len(string_split(text, chr(10))) <= 400 AS critical_passed, round((CAST(n_chars >= 100 AS INTEGER) + CAST(len(string_split(text, chr(10))) <= 400 AS INTEGER) + CAST(contains(text, '.') AS INTEGER)) / 3.0, 4) AS accuracy FROM documents")
def validation_report(spark, sf_dir):
    """Checks of a parsed text and the share that passed."""
    checks = [F.col("n_chars") >= 100, F.size(F.split("text", "\n")) <= 400, F.contains("text", F.lit("."))]
    return _docs(spark, sf_dir).select("doc_id", checks[0].alias("long_enough"), checks[1].alias("few_lines"), (checks[0] & checks[1]).alias("critical_passed"), F.round(sum((c.cast("int") for c in checks), F.lit(0)) / F.lit(3.0), 4).alias("accuracy"))


@query("SELECT source, count(*) AS docs, count(*) FILTER (WHERE regexp_matches(substr(text, 1, 4000), '(?i)licen[cs]e|copyright|http')) AS kept FROM documents GROUP BY source")
def domain_gate(spark, sf_dir):
    """Documents that a gate of domain patterns keeps, by source."""
    hit = F.rlike(F.substring("text", 1, 4000), F.lit("(?i)licen[cs]e|copyright|http"))
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs"), F.count(F.when(hit, 1)).alias("kept"))


@query()
def sentence_split(spark, sf_dir):
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(X.sentences_udf("text")).alias("n", "sentence"))
    return s.select("doc_id", "n", "sentence")


@query()
def text_chunks(spark, sf_dir):
    pieces = _docs(spark, sf_dir).select("doc_id", F.posexplode(X.chunk_udf(120)("text")).alias("ord", "text"))
    return pieces.select("doc_id", "ord", "text", F.size(F.split("text", r"\s+")).alias("n_words"))


@query()
def quote_places(spark, sf_dir):
    c = chunks(spark, sf_dir).where("ord = 0 AND n_chars >= 20").select("doc_id", F.upper("text").alias("quote"))
    found = c.join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id", X.locate_quote_udf("quote", "text").alias("at"))
    return found.select("doc_id", "at.start", "at.end")
