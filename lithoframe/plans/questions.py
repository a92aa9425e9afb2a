"""Queries of questions, model answers and page layout.

Benchmark items lend the names that documents are asked about; suppliers ask about
their nations; line items are records with a JSON form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.functions import text as X
from lithoframe.operators import answers as A
from lithoframe.operators import evidence as E
from lithoframe.operators import questions as Q
from lithoframe.operators import words as W
from lithoframe.plans.catalog import query
from lithoframe.plans.fact_graph import _AREAS, areas
from lithoframe.plans.upkeep import _index
from lithoframe.plans.views import CHUNKS, FACTS, chunks, facts, table


@query(
    r"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), p AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM t),
h AS (SELECT *, lag(word) OVER o AS before, lag(pos) OVER o AS prev FROM p WHERE word IN ('the', 'this') WINDOW o AS (PARTITION BY id ORDER BY pos))
SELECT id, round(sum(1.0 / (pos - prev)), 6) AS score FROM h WHERE before <> word GROUP BY id ORDER BY score DESC, id LIMIT 50"""
)
def cover_density(spark, sf_dir):
    return W.cover_density(_index(spark, sf_dir), [["the"], ["this"]], 50)


_KEYED = r"array_to_string(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')[1:{1}], ' ')"
_STARTS = r"list_transform(list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 4), lambda x: x[1:5])"


@query(
    rf"""WITH n AS (SELECT 'B' || item_id AS entity, {_KEYED.format('text', 2)} AS spelling FROM benchmark), h AS (SELECT item_id, {_KEYED.format('text', 2)} AS hint FROM benchmark),
q AS (SELECT doc_id AS id, text, hint, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS t FROM documents LEFT JOIN h ON lang <> 'en' AND doc_id % 8 = 0 AND item_id = doc_id // 8),
m AS (SELECT q.id, n.entity, 0 AS rank FROM q JOIN n ON q.hint = n.spelling UNION ALL SELECT q.id, n.entity, 1 FROM q JOIN n ON length(n.spelling) >= 4 AND contains(q.t, ' ' || n.spelling || ' ')
WHERE q.hint IS NULL OR len({_STARTS.format('q.hint')}) = 0 OR list_has_any({_STARTS.format('q.hint')}, {_STARTS.format('n.spelling')}))
SELECT id, entity FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, length(entity) DESC, entity) = 1"""
)
def resolved_entities(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    first = F.array_join(F.slice(W.text_tokens(F.col("text")), 1, 2), " ")
    names = items.select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("entity"), first.alias("spelling"))
    hints = items.select(F.col("item_id").alias("__i"), first.alias("hint"))
    docs = table(spark, sf_dir, "documents")
    asked = docs.join(hints, (F.col("lang") != "en") & (F.col("doc_id") % 8 == 0) & (F.col("__i") == F.floor(F.col("doc_id") / 8)), "left")
    return Q.resolve_entities(asked.select(F.col("doc_id").alias("id"), "text", "hint"), names)


@query(
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 2 THEN 'N' || s_nationkey END AS target, CASE s_suppkey % 5 WHEN 0 THEN 'gold' WHEN 1 THEN 'copper' WHEN 2 THEN 'tin' END AS deposits,
CASE s_suppkey % 5 WHEN 0 THEN 'ALL' WHEN 1 THEN 'TYPICAL' WHEN 2 THEN 'EXISTS' ELSE 'UNSPECIFIED' END AS quantifier, CASE WHEN s_suppkey % 5 = 4 THEN 'NEGATE' ELSE 'AFFIRM' END AS polarity,
CASE s_suppkey % 5 WHEN 3 THEN 'COMPARATIVE' WHEN 4 THEN 'RESEARCH_REVIEW' ELSE 'FACTUAL' END AS mode FROM supplier"""
)
def question_frames(spark, sf_dir):
    k, label = F.col("s_suppkey"), lambda n: F.concat(F.lit("landmark "), n.cast("string"))
    nation = F.col("s_nationkey")
    lead = F.element_at(F.array(*map(F.lit, ("gold in all parts of ", "typical copper of ", "is there any tin in ", "what is similar to ", "hypothesis of absence in "))), (k % 5 + 1).cast("int"))
    more = F.when(k % 4 == 1, F.concat(F.lit(", province "), F.col("n_regionkey").cast("string"))).when(k % 4 == 2, F.concat(F.lit(" and "), label((nation + 1) % 25))).when(k % 4 == 3, F.lit(" and the twin")).otherwise("")
    nations = table(spark, sf_dir, "nation")
    asked = table(spark, sf_dir, "supplier").join(nations, nation == F.col("n_nationkey")).select(k.alias("id"), F.concat(lead, label(nation), more).alias("text"))
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    aliases = nations.select(name("N", F.col("n_nationkey")).alias("area_id"), label(F.col("n_nationkey")).alias("alias"))
    aliases = aliases.unionByName(table(spark, sf_dir, "region").select(name("R", F.col("r_regionkey")).alias("area_id"), name("province ", F.col("r_regionkey")).alias("alias")))
    aliases = aliases.unionByName(nations.where("n_nationkey < 2").select(name("N", F.col("n_nationkey")).alias("area_id"), F.lit("twin").alias("alias")))
    return Q.question_frames(asked, E.find_areas(asked, aliases), E.area_closure(areas(spark, sf_dir)))


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'gold;tin' WHEN 1 THEN 'base_metals' END AS deposits, CASE o_orderkey % 3 WHEN 0 THEN 'late' WHEN 1 THEN 'post-ore' END AS stage FROM orders"""
)
def claim_subjects(spark, sf_dir):
    k = F.col("o_orderkey")
    quote = F.when(k % 3 == 0, "Gold  with cassiterite of the LATE stage").when(k % 3 == 1, "lead and zinc veins of the Post-ore phase").otherwise("a stage of basalt")
    return table(spark, sf_dir, "orders").select(k.alias("id"), Q.deposit_types(quote).alias("deposits"), Q.stage(quote).alias("stage"))


@query(
    """WITH v AS (SELECT * FROM (VALUES ('a', 0, 'ring'), ('a', 1, 'hoop'), ('a', 2, 'steel band'), ('b', 0, 'small'), ('b', 1, 'tiny')) AS t(g, ord, spelling)), q AS (SELECT p_partkey AS id, lower(p_name) AS t FROM part),
m AS (SELECT q.id, x.g, y.ord, trim(replace(' ' || t || ' ', ' ' || x.spelling || ' ', ' ' || y.spelling || ' ')) AS text FROM q JOIN v x ON contains(' ' || t || ' ', ' ' || x.spelling || ' ') AND x.ord = 0 JOIN v y ON y.g = x.g AND y.ord > 0)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY g, ord) AS INTEGER) AS n, text FROM m"""
)
def spelling_variants(spark, sf_dir):
    spellings = spark.createDataFrame([("a", 0, "ring"), ("a", 1, "hoop"), ("a", 2, "steel band"), ("b", 0, "small"), ("b", 1, "tiny")], "group string, ord int, spelling string")
    return Q.spelling_variants(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), spellings)


@query(
    f"""WITH {FACTS}, e AS (SELECT DISTINCT chunk_id // 8 AS chunk_id, node FROM (SELECT chunk_id, src AS node FROM facts UNION ALL SELECT chunk_id, dst FROM facts))
SELECT s_nationkey AS question, chunk_id, CAST(count(DISTINCT s_suppkey) AS DOUBLE) AS score FROM supplier JOIN e ON node = 'S' || s_suppkey OR node = 'P' || (s_suppkey % 200) GROUP BY ALL"""
)
def graph_scores(spark, sf_dir):
    k = F.col("s_suppkey")
    nodes = F.array(F.concat(F.lit("S"), k.cast("string")), F.concat(F.lit("P"), (k % 200).cast("string")))
    concepts = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("question"), k.alias("concept"), F.explode(nodes).alias("node"))
    f = facts(spark, sf_dir).select("id", F.floor(F.col("chunk_id") / 8).alias("chunk_id"), "src", "dst")
    return Q.node_scores(concepts, f)


@query(
    f"""WITH {_AREAS}, f AS (SELECT child AS id, length(child) AS chunk_id, child AS src, parent AS dst FROM areas), c AS (SELECT n_regionkey AS question, 'N' || n_nationkey AS concept FROM nation),
e AS (SELECT id, chunk_id, src AS node FROM f UNION ALL SELECT id, chunk_id, dst FROM f), d AS (SELECT DISTINCT question, concept, id, chunk_id FROM c JOIN e ON concept = node),
l AS (SELECT src AS node, dst AS other FROM f UNION SELECT dst, src FROM f), r AS (SELECT DISTINCT question, concept, id, chunk_id FROM c JOIN l ON concept = l.node JOIN e ON e.node = l.other),
x AS (SELECT DISTINCT question, concept, chunk_id, 1.0 AS w FROM d UNION ALL SELECT DISTINCT question, concept, chunk_id, 0.5 FROM r WHERE (question, concept, id) NOT IN (SELECT (question, concept, id) FROM d))
SELECT question, CAST(chunk_id AS INTEGER) AS chunk_id, CAST(sum(w) AS DOUBLE) AS score FROM x GROUP BY question, chunk_id"""
)
def graph_scores_with_neighbours(spark, sf_dir):
    f = areas(spark, sf_dir).select(F.col("child").alias("id"), F.length("child").alias("chunk_id"), F.col("child").alias("src"), F.col("parent").alias("dst"))
    node = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    return Q.node_scores(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("question"), node.alias("concept"), node.alias("node")), f, hop=True)


@query(
    f"""WITH {CHUNKS}, r AS (SELECT doc_id, ord, text, CASE WHEN ord % 7 = 3 THEN 'caption' WHEN ord % 7 = 5 THEN 'heading' ELSE 'text' END AS label FROM chunks), k AS (SELECT *, lag(text) OVER o AS bt, lag(label) OVER o AS bl FROM r WHERE label <> 'caption' WINDOW o AS (PARTITION BY doc_id ORDER BY ord)),
m AS (SELECT *, sum(CASE WHEN bl = 'text' AND bt <> '' AND NOT regexp_matches(bt, '[.!?:;…]\\s*$') AND label = 'text' AND regexp_matches(text, '^\\s*[a-zа-яё]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS g FROM k),
c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, g ORDER BY ord) > 1 THEN regexp_replace(text, '^\\s+', '') ELSE text END AS t, row_number() OVER (PARTITION BY doc_id, g ORDER BY ord) AS i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM m)
SELECT doc_id, CAST(min(ord) AS INTEGER) AS ord, string_agg(CASE WHEN i < n THEN regexp_replace(t, '\\s+$', '') ELSE t END, ' ' ORDER BY ord) AS text, CAST(count(*) AS INTEGER) AS pieces FROM c GROUP BY doc_id, g"""
)
def joined_paragraphs(spark, sf_dir):
    label = F.when(F.col("ord") % 7 == 3, "caption").when(F.col("ord") % 7 == 5, "heading").otherwise("text")
    return A.join_paragraphs(chunks(spark, sf_dir).withColumn("label", label))


@query(
    r"""WITH h AS (SELECT page_id, unnest(range(len(l))) AS ord, unnest(l) AS level, unnest(t) AS title FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h([1-4])\b[^>]*>(.*?)</h[1-4]\s*>', 1) AS l, regexp_extract_all(html, '(?is)<h([1-4])\b[^>]*>(.*?)</h[1-4]\s*>', 2) AS t FROM pages)),
c AS (SELECT page_id, CAST(ord AS INTEGER) AS ord, CAST(level AS INTEGER) AS level, trim(regexp_replace(regexp_replace(regexp_replace(title, '<[^>]*>', ' ', 'g'), '&[#a-zA-Z0-9]+;', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS title FROM h) SELECT * FROM c WHERE title <> '' AND length(title) < 300"""
)
def page_sections(spark, sf_dir):
    return A.page_sections(table(spark, sf_dir, "pages"))


_SCHEMA = {
    "type": "object",
    "required": ["key", "flag", "line"],
    "additionalProperties": False,
    "properties": {"key": {"type": "integer", "minimum": 1}, "flag": {"enum": ["A", "N"]}, "line": {"type": "object", "properties": {"discount": {"type": "number", "maximum": 0.05}, "mode": {"type": "string", "minLength": 3, "maxLength": 8, "pattern": "^[A-Z]"}}}},
}


@query(
    """SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_linenumber = 4 THEN '$: json' END, CASE WHEN l_linenumber = 3 THEN '$.flag: required' END, CASE WHEN l_linenumber = 2 THEN '$: additionalProperties' END, CASE WHEN l_linenumber = 1 THEN '$.key: type' END,
CASE WHEN l_linenumber <> 4 AND l_linenumber <> 1 AND l_orderkey < 1 THEN '$.key: minimum' END, CASE WHEN l_linenumber NOT IN (3, 4) AND l_returnflag = 'R' THEN '$.flag: enum' END, CASE WHEN l_linenumber <> 4 AND l_discount > 0.05 THEN '$.line.discount: maximum' END, CASE WHEN l_linenumber <> 4 AND length(l_returnflag || l_linestatus || l_linenumber) < 3 THEN '$.line.mode: minLength' END], lambda x: x IS NOT NULL), '; ') AS problems FROM lineitem"""
)
def json_problems(spark, sf_dir):
    c, n = F.col, F.col("l_linenumber")
    as_text = lambda x: c(x).cast("string")
    key = F.when(n == 1, F.concat(F.lit('"'), as_text("l_orderkey"), F.lit('"'))).otherwise(as_text("l_orderkey"))
    flag = F.when(n == 3, "").otherwise(F.concat(F.lit(', "flag": "'), c("l_returnflag"), F.lit('"')))
    line = F.concat(F.lit(', "line": {"discount": '), c("l_discount").cast("decimal(6,2)").cast("string"), F.lit(', "mode": "'), c("l_returnflag"), c("l_linestatus"), as_text("l_linenumber"), F.lit('"}'))
    text = F.concat(F.lit('{"key": '), key, flag, line, F.when(n == 2, ', "more": 1').otherwise(""), F.when(n == 4, "").otherwise("}"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(A.json_problems(text, _SCHEMA), "; ").alias("problems"))


@query("""SELECT p_partkey, '- name: "' || p_name || '"' || chr(10) || '  size: ' || p_size || chr(10) || '  note: ' || CASE WHEN p_size > 25 THEN 'null' ELSE '"a \\"' || p_brand || '\\""' END AS item FROM part""")
def yaml_items(spark, sf_dir):
    note = F.when(F.col("p_size") <= 25, F.concat(F.lit('a "'), "p_brand", F.lit('"')))
    return table(spark, sf_dir, "part").select("p_partkey", A.yaml_items({"name": F.col("p_name"), "size": F.col("p_size"), "note": note}).alias("item"))


@query()
def checked_facts(spark, sf_dir):
    """Every sentence of the documents as a row whose ends are its first and last word."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), X.sentences_udf("text").alias("sents"))
    each = docs.select("chunk_id", F.posexplode("sents").alias("ord", "s")).withColumn("w", W.text_tokens(F.col("s")))
    rows = each.select("chunk_id", "ord", (F.col("ord") + 1).cast("string").alias("n"), F.get("w", F.lit(0)).alias("src"), F.lit("связан с").alias("relation"), F.element_at("w", -1).alias("dst")).where("src IS NOT NULL")
    return A.checked_facts(rows, docs)[0]


@query()
def checked_items(spark, sf_dir):
    """Each document's second word, quoted with its first 60 characters, about what the first word names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk_id"), "text")
    items = docs.select("doc_id", F.lit(0).alias("ord"), F.get(W.text_tokens(F.col("text")), F.lit(1)).alias("what"), F.substring("text", 1, 60).alias("quote"), (F.col("doc_id") % 2).cast("int").alias("fragment"))
    return A.checked_items(items, docs, ["the", "le"])
