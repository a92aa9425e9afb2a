"""Queries of upkeep, inverted-index search and answer sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.operators import upkeep as U
from lithoframe.operators import words as W
from lithoframe.plans.catalog import query
from lithoframe.plans.scratch import materialize
from lithoframe.plans.views import FACTS, facts, table

_NEW = "new_ AS (SELECT o_orderkey * 100 + 1 AS id, o_orderkey * 8 + 1 AS chunk_id, 'S0' AS src, 'new' AS relation, 'P0' AS dst FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey * 100 + 2, o_orderkey * 8 + 1, 'S0', 'new', 'P0' FROM orders WHERE o_orderpriority = '1-URGENT')"


@query(
    f"""WITH {FACTS}, {_NEW}, done AS (SELECT o_orderkey * 8 + 1 AS chunk_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))
SELECT id, chunk_id, src, relation, dst FROM facts WHERE chunk_id NOT IN (SELECT chunk_id FROM done) UNION ALL SELECT min(id), chunk_id, src, relation, dst FROM new_ GROUP BY chunk_id, src, relation, dst"""
)
def saved_facts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    new = orders.where("o_orderpriority = '1-URGENT'").select(F.explode(F.array(key * 100 + 1, key * 100 + 2)).alias("id"), (key * 8 + 1).alias("chunk_id"), F.lit("S0").alias("src"), F.lit("new").alias("relation"), F.lit("P0").alias("dst"))
    done = orders.where("o_orderpriority IN ('1-URGENT', '5-LOW')").select((key * 8 + 1).alias("chunk_id"))
    return U.save_facts(facts(spark, sf_dir).select("id", "chunk_id", "src", "relation", "dst"), new, done)


@query("SELECT l_orderkey AS chunk_id, count(*) AS n, string_agg(reason, '; ' ORDER BY rn) FILTER (WHERE rn <= 3) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, reason) AS rn FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linenumber AS reason FROM lineitem)) GROUP BY l_orderkey")
def rejection_notes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("reason"))
    return U.rejection_notes(rows, 3)


_SKIP = "skipped AS (SELECT o_orderkey * 8 + 2 AS chunk_id, o_orderstatus AS reason FROM orders WHERE o_orderstatus = 'O')"


@query(f"WITH {FACTS}, {_SKIP} SELECT chunk_id, CAST(NULL AS VARCHAR) AS reason FROM facts WHERE chunk_id NOT IN (SELECT chunk_id FROM skipped) UNION ALL SELECT chunk_id, reason FROM skipped")
def skip_marks(spark, sf_dir):
    f = facts(spark, sf_dir)
    skipped = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select((F.col("o_orderkey") * 8 + 2).alias("chunk_id"), F.col("o_orderstatus").alias("reason"))
    return U.mark_skipped(f.select("chunk_id", F.lit(None).cast("string").alias("reason")), f, skipped)[0]


@query(f"WITH {FACTS}, {_SKIP} SELECT id, chunk_id FROM facts WHERE chunk_id NOT IN (SELECT chunk_id FROM skipped)")
def facts_without_skipped(spark, sf_dir):
    f = facts(spark, sf_dir).select("id", "chunk_id")
    skipped = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select((F.col("o_orderkey") * 8 + 2).alias("chunk_id"), F.col("o_orderstatus").alias("reason"))
    return U.mark_skipped(f.select("chunk_id", F.lit(None).cast("string").alias("reason")), f, skipped)[1]


@query(
    f"""WITH {FACTS}, want AS (SELECT id, src || ' ' || relation || ' ' || dst AS text FROM facts WHERE votes >= 2), have AS (SELECT id, src || ' ' || (CASE WHEN typed THEN relation ELSE 'old' END) || ' ' || dst AS text FROM facts WHERE NOT stale)
SELECT coalesce(w.id, h.id) AS id, CASE WHEN h.id IS NULL THEN 'insert' WHEN w.id IS NULL THEN 'delete' ELSE 'update' END AS action FROM want w FULL JOIN have h ON w.id = h.id WHERE w.id IS NULL OR h.id IS NULL OR w.text <> h.text"""
)
def vector_changes(spark, sf_dir):
    f = facts(spark, sf_dir)
    wanted = f.where("votes >= 2").select("id", F.concat_ws(" ", "src", "relation", "dst").alias("text"))
    have = f.where("NOT stale").select("id", F.concat_ws(" ", "src", F.when(F.col("typed"), F.col("relation")).otherwise("old"), "dst").alias("text"))
    return U.vector_changes(wanted, have)


@query(f"WITH {FACTS} SELECT id, CASE WHEN stale THEN 'stale' WHEN votes IS NULL THEN 'no votes' WHEN length(dst) < 3 THEN 'short' END AS problem FROM facts")
def rechecked_facts(spark, sf_dir):
    rules = [("stale", F.col("stale")), ("no votes", F.col("votes").isNull()), ("short", F.length("dst") < 3)]
    return U.recheck(facts(spark, sf_dir), rules).select("id", "problem")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name || ' ' || p_brand || ' ' || p_type, '(?i)ring|bolt') AND regexp_matches(p_type, '(?i)econ')")
def facts_about(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("src"), F.col("p_brand").alias("dst"), F.col("p_type").alias("quote"))
    return U.about(part, "ring|bolt", "econ").select("p_partkey")


@query("WITH c AS (SELECT doc_id AS chunk_id, text, trim(regexp_replace(text, '[0-9]+', '', 'g'), ' ') AS t FROM documents) SELECT chunk_id, t AS text, t <> text AS changed FROM c WHERE length(t) >= 20")
def tidied_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return U.tidy(docs, docs.select("chunk_id", F.substring("text", 1, 15).alias("quote")), F.trim(F.regexp_replace("text", "[0-9]+", "")), 20)[0]


@query("WITH c AS (SELECT doc_id AS chunk_id, substr(text, 1, 15) AS quote, trim(regexp_replace(text, '[0-9]+', '', 'g'), ' ') AS t FROM documents) SELECT chunk_id, quote FROM c WHERE length(t) >= 20 AND contains(t, quote)")
def facts_after_tidying(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return U.tidy(docs, docs.select("chunk_id", F.substring("text", 1, 15).alias("quote")), F.trim(F.regexp_replace("text", "[0-9]+", "")), 20)[1]


@query("SELECT 'status' AS field, count(*) AS n, round(avg(CASE WHEN l_linestatus = o_orderstatus THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'year', count(*), round(avg(CASE WHEN year(l_shipdate) = year(o_orderdate) THEN 1.0 ELSE 0.0 END), 6) FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def field_agreement(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return U.agreement(pairs.select(F.col("l_linestatus").alias("status"), F.col("o_orderstatus").alias("status_gold"), F.year("l_shipdate").alias("year"), F.year("o_orderdate").alias("year_gold")), ["status", "year"])


@query(
    """WITH g AS (SELECT k, t FROM (VALUES ('en'), ('en+fr'), ('de+es')) AS a(k), (VALUES (200), (1000)) AS b(t)) SELECT k AS kinds, CAST(t AS INTEGER) AS threshold, count(*) FILTER (WHERE contains('+' || k || '+', '+' || lang || '+') AND n_chars < t) AS dropped,
CAST(coalesce(sum(toxic) FILTER (WHERE contains('+' || k || '+', '+' || lang || '+') AND n_chars < t), 0) AS BIGINT) AS facts FROM g, (SELECT d.lang, d.n_chars, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id) GROUP BY k, t"""
)
def threshold_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("lang").alias("kind"), F.col("n_chars").alias("chars"), F.col("toxic").alias("facts"))
    return U.threshold_grid(rows, [["en"], ["en", "fr"], ["de", "es"]], [200, 1000])


@query(
    """WITH c AS (SELECT DISTINCT o_custkey AS answer, CAST(c_nationkey AS INTEGER) AS target, l_suppkey AS doc_id FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey), r AS (SELECT s_suppkey AS doc_id, CAST(s_nationkey AS INTEGER) AS region FROM supplier WHERE s_acctbal > 0)
SELECT answer, target, count(*) FILTER (WHERE region = target) AS own, count(*) FILTER (WHERE region <> target) AS "foreign", count(*) FILTER (WHERE region IS NULL) AS unknown FROM c LEFT JOIN r ON r.doc_id = c.doc_id GROUP BY answer, target"""
)
def foreign_citations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    cited = orders.select(F.col("o_custkey").alias("answer"), F.col("c_nationkey").cast("int").alias("target"), F.col("l_suppkey").alias("doc_id"))
    regions = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("doc_id"), F.col("s_nationkey").cast("int").alias("region"))
    return U.foreign_citations(cited, regions)


@query("SELECT doc_id, CASE WHEN n_chars < 50 THEN 'scan' WHEN len(regexp_extract_all(text, '[^\\x00-\\x7F]')) / greatest(n_chars, 1) > 0.02 THEN 'broken' WHEN contains(text, '<') THEN 'marked' WHEN len(regexp_extract_all(text, '-')) / greatest(n_chars, 1) > 0.001 THEN 'hyphenated' ELSE 'plain' END AS variant FROM documents")
def document_variants(spark, sf_dir):
    n = F.greatest(F.col("n_chars"), F.lit(1))
    share = lambda p: F.regexp_count("text", F.lit(p)) / n
    variant = U.document_variant(F.col("n_chars"), share(r"[^\x00-\x7F]"), F.contains("text", F.lit("<")), share("-"), most_garbage=0.02, most_hyphens=0.001)
    return table(spark, sf_dir, "documents").select("doc_id", variant.alias("variant"))


def _index(spark, sf_dir):
    return materialize(W.word_index(table(spark, sf_dir, "documents"), id_col="doc_id"), "words")


#: A text's words between single spaces, as DuckDB sees them.
_SPACED = r"t AS (SELECT doc_id AS id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)"
_HITS = "len(list_filter(w, lambda x: x IN ({})))"


def _scored(*groups: str) -> str:
    return "round(" + " + ".join(f"{_HITS.format(g)} / ({_HITS.format(g)} + 1.0)" for g in groups) + ", 6)"


@query(f"WITH {_SPACED} SELECT id, CAST({_scored(chr(39) + 'of' + chr(39), chr(39) + 'the' + chr(39))} AS DOUBLE) AS score FROM t WHERE contains(t, ' of the ') ORDER BY score DESC, id LIMIT 50")
def phrase_search(spark, sf_dir):
    return W.search_index(_index(spark, sf_dir), W.parse('"of the"'), 50)


@query(f"WITH {_SPACED} SELECT id, CAST({_scored(chr(39) + 'this' + chr(39))} AS DOUBLE) AS score FROM t WHERE contains(t, ' this ') AND NOT contains(t, ' with ') ORDER BY score DESC, id LIMIT 50")
def excluding_search(spark, sf_dir):
    return W.search_index(_index(spark, sf_dir), W.parse("this -with"), 50)


@query(f"WITH {_SPACED} SELECT id, CAST({_scored(chr(39) + 'ring' + chr(39) + ',' + chr(39) + 'rings' + chr(39), chr(39) + 'tion' + chr(39) + ',' + chr(39) + 'tions' + chr(39))} AS DOUBLE) AS score FROM t WHERE (contains(t, ' ring ') OR contains(t, ' rings ') OR contains(t, ' tion ') OR contains(t, ' tions ')) ORDER BY score DESC, id LIMIT 50")
def variant_search(spark, sf_dir):
    return W.search_index(_index(spark, sf_dir), W.parse("ring tion", any_word=True, variants=lambda w: (w + "s",)), 50)


@query(r"WITH n AS (SELECT p_partkey, regexp_replace(' (the ' || p_name || '), ', '\s+', ' ', 'g') AS raw FROM part) SELECT p_partkey, regexp_replace(regexp_replace(trim(raw), '^[\s.,;:!?''" + '"' + r"«»()\[\]-]+|[\s.,;:!?''" + '"' + r"«»(\[-]+$', '', 'g'), '^(in|of|at|on|from|the|a|an|в|во|на|из|от)\s+', '', 'i') AS name, lower(p_type) AS relation FROM part JOIN n USING (p_partkey)")
def cleaned_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", W.clean_name(F.concat(F.lit(" (the "), "p_name", F.lit("), "))).alias("name"), W.clean_relation(F.concat(F.lit(" -"), "p_type", F.lit(". "))).alias("relation"))


@query(
    f"""WITH {FACTS}, r AS (SELECT chunk_id // 8 AS chunk_id, id, round(1.0 / (1 + id % 97), 6) AS similarity FROM facts WHERE chunk_id // 8 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY similarity DESC, id) = 1) SELECT CAST(chunk_id AS BIGINT) AS chunk_id, id, CAST(similarity AS DOUBLE) AS similarity FROM b ORDER BY similarity DESC, id LIMIT 2"""
)
def fact_extras(spark, sf_dir):
    f = facts(spark, sf_dir).select(F.floor(F.col("chunk_id") / 8).alias("chunk_id"), "id", F.round(1.0 / (1 + F.col("id") % 97), 6).alias("similarity"))
    found = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("chunk_id"))
    return W.fact_extras(f, found, 2)


@query("WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber AS figure, l_returnflag = 'R' AS named, l_discount * 10 AS similarity FROM lineitem) SELECT doc_id, figure, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY named DESC, similarity DESC, figure) AS place FROM f WHERE named OR similarity >= 0.44) WHERE place <= 2")
def figures_for_answer(spark, sf_dir):
    c = F.col
    return W.figures_for_answer(table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("figure"), (c("l_returnflag") == "R").alias("named"), (c("l_discount") * 10).alias("similarity")))


@query("WITH h AS (SELECT l_orderkey AS question, l_linenumber AS n, l_suppkey % 3 AS doc_id FROM lineitem) SELECT a.question, a.n AS first, b.n AS second, CAST(row_number() OVER (PARTITION BY a.question ORDER BY a.n, b.n) AS INTEGER) AS place FROM h a JOIN h b ON a.question = b.question AND a.n < b.n AND a.doc_id <> b.doc_id QUALIFY place <= 6")
def cross_document_pairs(spark, sf_dir):
    c = F.col
    return W.cross_document_pairs(table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("question"), c("l_linenumber").alias("n"), (c("l_suppkey") % 3).alias("doc_id")))
