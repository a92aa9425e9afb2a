"""Queries of the relational operators: joins, aggregates, windows, sorts, sets and table upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lithoframe.operators import facts as K
from lithoframe.operators import search as S
from lithoframe.operators import tables as T
from lithoframe.plans.catalog import query
from lithoframe.plans.views import CHUNKS, FACTS, chunks, facts, table


@query("SELECT count(*) AS docs, count(text) AS with_text, count(DISTINCT source) AS sources, min(n_chars) AS shortest, max(n_chars) AS longest, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS vectors, (SELECT year(min(ts)) FROM events) AS first_year, (SELECT year(max(ts)) FROM events) AS last_year FROM documents")
def corpus_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("docs"), F.count("text").alias("with_text"), F.count_distinct("source").alias("sources"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))
    vectors = table(spark, sf_dir, "embeddings").agg(F.count("embedding").alias("vectors"))
    years = table(spark, sf_dir, "events").agg(F.year(F.min("ts")).cast("long").alias("first_year"), F.year(F.max("ts")).cast("long").alias("last_year"))
    return docs.join(vectors, F.lit(True)).join(years, F.lit(True))


@query(f"WITH {CHUNKS} SELECT c.doc_id, c.ord, c.n_chars, e.label, e.vec_id FROM chunks c JOIN documents d ON d.doc_id = c.doc_id JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.lang = 'en'")
def chunk_document_vector_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id", "label")
    return chunks(spark, sf_dir).join(docs, "doc_id").join(vectors, "doc_id").select("doc_id", "ord", "n_chars", "label", "vec_id")


@query("SELECT c.c_custkey, count(o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def documents_with_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_todo(spark, sf_dir):
    return T.todo(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


_DONE = "done AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'copy of ' || (doc_id * 3 % 2000) ELSE NULL END AS skipped FROM labels)"


@query(f"WITH {_DONE} SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.doc_id = d.doc_id) OR EXISTS (SELECT 1 FROM done x WHERE x.doc_id = d.doc_id AND x.skipped IS NOT NULL AND NOT EXISTS (SELECT 1 FROM done y WHERE y.doc_id = CAST(regexp_extract(x.skipped, '([0-9]+)$', 1) AS BIGINT)))")
def todo_with_retry(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, F.concat(F.lit("copy of "), (F.col("doc_id") * 3 % 2000).cast("string"))).alias("skipped"))
    return T.todo_with_retry(table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id")


_ACCEPTED = f"""WITH {FACTS}, rep AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi FROM facts GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT f.*, coalesce(f.votes, 0) >= 3 OR (least(src, dst), greatest(src, dst)) IN (SELECT lo, hi FROM rep) AS accepted FROM facts f)"""


@query(f"{_ACCEPTED} SELECT id, src, dst, votes FROM marked WHERE accepted")
def accepted_facts(spark, sf_dir):
    return K.with_accepted(facts(spark, sf_dir)).where("accepted").select("id", "src", "dst", "votes")


@query(f"{_ACCEPTED} SELECT id, votes FROM marked WHERE NOT accepted")
def candidate_facts(spark, sf_dir):
    return K.with_accepted(facts(spark, sf_dir)).where("NOT accepted").select("id", "votes")


@query(
    f"""WITH {FACTS}, rep AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi FROM facts WHERE NOT stale GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 1)
SELECT count(*) AS facts, count(*) FILTER (WHERE NOT stale AND (coalesce(votes, 0) >= 3 OR (least(src, dst), greatest(src, dst)) IN (SELECT lo, hi FROM rep))) AS accepted FROM facts"""
)
def fresh_accepted_count(spark, sf_dir):
    return K.with_accepted(facts(spark, sf_dir), fresh=True).agg(F.count("*").alias("facts"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"))


@query(f"WITH {FACTS} SELECT id, rel_type FROM facts WHERE NOT (typed AND rel_type IS NULL)")
def typed_facts(spark, sf_dir):
    return K.typed_only(facts(spark, sf_dir)).select("id", "rel_type")


@query(f"WITH {FACTS} SELECT id, src, dst FROM facts WHERE src IN ('S1', 'S2') OR contains(src, 'S9') OR dst IN ('S1', 'S2') OR contains(dst, 'S9')")
def end_key_filter(spark, sf_dir):
    return K.end_filter(facts(spark, sf_dir), ["S1", "S2"], ["S9"]).select("id", "src", "dst")


@query(f"WITH {FACTS} SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, count(DISTINCT doc_id) AS docs, count(*) AS facts FROM facts WHERE src <> dst GROUP BY 1, 2")
def pair_degree(spark, sf_dir):
    return K.pair_degree(facts(spark, sf_dir))


@query(f"WITH {FACTS} SELECT key, count(DISTINCT doc_id) AS docs, count(*) AS facts FROM (SELECT src AS key, doc_id FROM facts UNION ALL SELECT dst, doc_id FROM facts) GROUP BY key ORDER BY docs DESC, facts DESC, key LIMIT 50")
def top_keys_union(spark, sf_dir):
    return K.top_keys(facts(spark, sf_dir), 50)


@query(
    f"""WITH {FACTS} SELECT src, relation, CAST(n AS BIGINT) AS n, spellings FROM (SELECT src, first(relation ORDER BY n DESC, first_id) AS relation, sum(n) AS n, count(*) AS spellings
FROM (SELECT src, relation, count(*) AS n, min(id) AS first_id FROM facts GROUP BY 1, 2) GROUP BY src)"""
)
def spelling_mode(spark, sf_dir):
    return K.most_common(facts(spark, sf_dir), "src", "relation", "id")


@query(f"WITH {FACTS} SELECT src, relation, count(*) AS n, min(id) AS first_id FROM facts GROUP BY 1, 2")
def spellings_histogram(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("src", "relation").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {FACTS} SELECT id FROM facts f WHERE EXISTS (SELECT 1 FROM facts g WHERE least(g.src, g.dst) = least(f.src, f.dst) AND greatest(g.src, g.dst) = greatest(f.src, f.dst) AND g.doc_id <> f.doc_id)")
def semi_join_pairs(spark, sf_dir):
    return K.partners(facts(spark, sf_dir)).select("id")


@query(
    f"""WITH {FACTS}, firsts AS (SELECT src, relation, dst, doc_id, min(id) AS id, count(*) AS n FROM facts GROUP BY ALL), numbered AS (SELECT *, row_number() OVER (PARTITION BY src, relation, dst ORDER BY id) AS rn FROM firsts)
SELECT src, relation, dst, CAST(sum(n) AS BIGINT) AS facts, count(*) AS docs, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE rn <= 3) AS quotes FROM numbered GROUP BY src, relation, dst"""
)
def link_quotes(spark, sf_dir):
    return K.link_quotes(facts(spark, sf_dir))


@query(f"WITH {FACTS} SELECT count(*) AS facts, max(id) AS last_id, count(votes) AS voted, CAST(sum(votes) AS BIGINT) AS votes, count(*) FILTER (WHERE typed) AS typed, count(rel_type) AS with_type FROM facts")
def graph_stamp(spark, sf_dir):
    return K.stamp(facts(spark, sf_dir))


@query(
    f"""WITH {FACTS}, s AS (SELECT src, dst, relation, min(id) AS id FROM facts GROUP BY ALL)
SELECT a.src, a.dst, a.relation AS relation_a, b.relation AS relation_b, a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.src = b.src AND a.dst = b.dst AND a.relation < b.relation"""
)
def conflict_pairs(spark, sf_dir):
    return K.conflict_pairs(facts(spark, sf_dir))


@query("SELECT status, count(*) AS orders, CAST(sum(size) AS BIGINT) AS lines, max(last) AS last_price FROM (SELECT o_orderstatus AS status, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS size, o_totalprice AS last FROM orders) GROUP BY status")
def pass_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders"), F.sum(F.coalesce("size", F.lit(0))).alias("lines"), F.max("o_totalprice").alias("last_price"))


@query(
    """WITH r AS (SELECT event_id, split_part(event_type || ':' || props, ':', 1) AS kind FROM events)
SELECT kind, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE rn <= 2) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY event_id) AS rn FROM r) GROUP BY kind"""
)
def reasons_with_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.split_part(F.concat_ws(":", "event_type", "props"), F.lit(":"), F.lit(1)).alias("kind"))
    numbered = rows.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy("event_id")))
    return numbered.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= 2, F.col("event_id")))), lambda x: x.cast("string")), ",").alias("examples"))


@query("SELECT word, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY word")
def unnest_count(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("parts"))


@query("SELECT doc_id, source, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1")
def latest_journal_record(spark, sf_dir):
    return T.latest(table(spark, sf_dir, "documents"), ["source", "lang"], [F.desc("doc_id")]).select("doc_id", "source", "lang", "n_chars")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, CAST(max(o_totalprice) AS DOUBLE) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def upsert_merge(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return T.upsert(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), changes, ["c_custkey"])


@query(
    f"""WITH {CHUNKS}, o AS (SELECT doc_id, ord, text FROM chunks WHERE doc_id % 2 = 0), n AS (SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN text || '.' ELSE text END AS text FROM chunks WHERE doc_id % 3 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.ord, n.ord) AS ord, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.text IS NOT DISTINCT FROM n.text THEN 'keep' ELSE 'update' END AS action
FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id AND o.ord = n.ord"""
)
def replacement_plan(spark, sf_dir):
    c = chunks(spark, sf_dir).select("doc_id", "ord", "text")
    new = c.where("doc_id % 3 = 0").withColumn("text", F.when(F.col("ord") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return T.replacement_plan(c.where("doc_id % 2 = 0"), new, ["doc_id", "ord"], "text")


@query(
    f"""WITH {CHUNKS}, q AS (SELECT doc_id, ord, doc_id + (CASE WHEN ord = 1 THEN 1 ELSE 0 END) AS chunk_id, substr(text, 1, 30) AS quote FROM chunks WHERE ord <= 1)
SELECT q.doc_id, q.ord, coalesce(contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(q.quote, '\\s+', ' ', 'g')))), FALSE) AS found FROM q LEFT JOIN documents d ON d.doc_id = q.chunk_id"""
)
def stale_quotes(spark, sf_dir):
    quotes = chunks(spark, sf_dir).where("ord <= 1").select("doc_id", "ord", (F.col("doc_id") + F.when(F.col("ord") == 1, 1).otherwise(0)).alias("chunk_id"), F.substring("text", 1, 30).alias("quote"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return T.mark_stale(quotes, texts).select("doc_id", "ord", "found")


@query(f"WITH {CHUNKS} SELECT doc_id, sha256(string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) ORDER BY ord)) AS fingerprint, count(*) AS parts FROM chunks GROUP BY doc_id")
def parse_fingerprint(spark, sf_dir):
    return T.fingerprint(chunks(spark, sf_dir), "doc_id", "ord", "text")


@query("SELECT d.doc_id, f.first_id, d.doc_id > f.first_id AS copy FROM documents d JOIN (SELECT sha256(text) AS h, min(doc_id) AS first_id FROM documents GROUP BY 1) f ON sha256(d.text) = f.h")
def file_hash_copies(spark, sf_dir):
    return T.first_by_hash(table(spark, sf_dir, "documents"), F.col("text"), "doc_id").select("doc_id", "first_id", "copy")


@query("SELECT user_id AS decision_id, arg_max(event_type, event_id) AS status, arg_max(props, event_id) AS reason, count(*) AS events FROM events GROUP BY user_id")
def override_log(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("decision_id"), F.col("event_type").alias("new_status"), F.col("props").alias("reason"), F.col("event_id").alias("at"))
    return T.read_overrides(log)


@query(
    f"""WITH {CHUNKS}, hits AS (SELECT doc_id, count(*) FILTER (WHERE contains(lower(text), 'the ') OR contains(lower(text), 'der ')) AS hits FROM chunks GROUP BY doc_id)
SELECT d.doc_id, contains(lower(d.source), 'src1') AS by_title, coalesce(h.hits, 0) AS hits, CASE WHEN d.n_chars % 7 = 0 THEN NULL ELSE 1990 + d.n_chars % 30 END AS year, CAST(row_number() OVER (ORDER BY contains(lower(d.source), 'src1') DESC, coalesce(h.hits, 0) DESC, CASE WHEN d.n_chars % 7 = 0 THEN NULL ELSE 1990 + d.n_chars % 30 END DESC NULLS LAST, d.doc_id) AS INTEGER) AS place
FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id WHERE contains(lower(d.source), 'src1') OR coalesce(h.hits, 0) >= 2 ORDER BY place LIMIT 200"""
)
def catalog_by_stems(spark, sf_dir):
    """Documents by title match or two chunks that match a stem; chunk counts are aggregated once."""
    low = F.lower("text")
    hits = chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.when(F.contains(low, F.lit("the ")) | F.contains(low, F.lit("der ")), 1)).alias("hits"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.contains(F.lower("source"), F.lit("src1")).alias("by_title"), F.when(F.col("n_chars") % 7 != 0, 1990 + F.col("n_chars") % 30).alias("year"))
    found = docs.join(hits, "doc_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0))).where("by_title OR hits >= 2")
    order = [F.desc("by_title"), F.desc("hits"), F.desc_nulls_last("year"), F.col("doc_id")]
    return S.ranked(found.orderBy(*order).limit(200), order, "place").select("doc_id", "by_title", "hits", "year", "place")


@query("SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def paged_listing(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    page = customers.orderBy(F.desc("c_acctbal"), "c_custkey").offset(50).limit(25)
    return page.join(F.broadcast(customers.agg(F.count("*").alias("total"))), F.lit(True))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderstatus = 'P', o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, o_orderkey LIMIT 120")
def priority_order(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_orderstatus") == "P", (F.col("o_orderpriority") == "1-URGENT").desc(), F.desc("o_orderdate"), "o_orderkey").limit(120).select("o_orderkey", "o_orderpriority")


@query(f"WITH {CHUNKS} SELECT doc_id, ord, substr(CASE WHEN lag(ord) OVER w = ord - 1 THEN lag(text) OVER w END, 1, 20) AS before, substr(CASE WHEN lead(ord) OVER w = ord + 1 THEN lead(text) OVER w END, 1, 20) AS after FROM chunks WHERE n_chars > 20 WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def neighbour_chunks(spark, sf_dir):
    near = S.neighbours(chunks(spark, sf_dir).where("n_chars > 20"))
    return near.select("doc_id", "ord", F.substring("before", 1, 20).alias("before"), F.substring("after", 1, 20).alias("after"))


@query(
    """WITH keys AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS key FROM part), freq AS (SELECT key, count(*) AS n FROM keys GROUP BY key),
brands AS (SELECT p_brand AS brand, unnest(string_split(lower(min(p_name)), ' ')) AS key FROM part GROUP BY p_brand)
SELECT p_partkey, brand, key FROM (SELECT k.p_partkey, b.brand, k.key, row_number() OVER (PARTITION BY k.p_partkey ORDER BY f.n, k.key, b.brand) AS rn FROM keys k JOIN freq f USING (key) JOIN brands b USING (key)) WHERE rn = 1"""
)
def best_key_match(spark, sf_dir):
    """Each part meets the row that shares its least frequent key."""
    part = table(spark, sf_dir, "part")
    keys = part.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("key"))
    freq = keys.groupBy("key").agg(F.count("*").alias("n"))
    brands = part.groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_name").alias("name")).select("brand", F.explode(F.split(F.lower("name"), " ")).alias("key"))
    met = keys.join(freq, "key").join(brands, "key")
    return S.top_per_group(met, "p_partkey", [F.col("n"), F.col("key"), F.col("brand")], 1).select("p_partkey", "brand", "key")


@query("SELECT n.n_name AS name, r.r_name AS canon, count(*) AS customers FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2")
def canonical_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.col("n_name").alias("name"), F.col("r_name").alias("canon"))
    return table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("name", "canon").agg(F.count("*").alias("customers"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").exceptAll(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")).distinct()


@query("SELECT quality, count(*) FILTER (WHERE toxic = 0) AS toxic_0, count(*) FILTER (WHERE toxic = 1) AS toxic_1 FROM labels GROUP BY quality")
def filtered_counts(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.when(F.col("toxic") == 0, 1)).alias("toxic_0"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic_1"))


@query(
    """SELECT coalesce(lang, 'ALL') AS lang, coalesce(source, 'ALL') AS source, k, count(*) FILTER (WHERE n_chars / 500 >= k) AS kept, count(*) AS docs
FROM documents, (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY GROUPING SETS ((k), (k, lang), (k, source), (k, lang, source))"""
)
def threshold_sweep(spark, sf_dir):
    """Every threshold by language, source and over all, in one pass by grouping sets."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("k"), "n_chars")
    cube = docs.groupingSets([["k"], ["k", "lang"], ["k", "source"], ["k", "lang", "source"]], "k", "lang", "source")
    return cube.agg(F.count(F.when(F.col("n_chars") / 500 >= F.col("k"), 1)).alias("kept"), F.count("*").alias("docs")).select(F.coalesce("lang", F.lit("ALL")).alias("lang"), F.coalesce("source", F.lit("ALL")).alias("source"), "k", "kept", "docs")


@query("SELECT source, round(avg(quality), 2) AS quality, count(quality) AS judged, CAST(row_number() OVER (ORDER BY coalesce(round(avg(quality), 2), -1), source) AS INTEGER) AS place FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def mean_by_group_ascending(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    means = joined.groupBy("source").agg(F.round(F.avg("quality"), 2).alias("quality"), F.count("quality").alias("judged"))
    return S.ranked(means, [F.coalesce("quality", F.lit(-1.0)), F.col("source")], "place")


@query(
    f"""WITH {FACTS} SELECT 'all' AS stage, count(*) AS n FROM facts UNION ALL SELECT 'fresh', count(*) FROM facts WHERE NOT stale UNION ALL SELECT 'voted', count(*) FROM facts WHERE NOT stale AND votes IS NOT NULL
UNION ALL SELECT 'confirmed', count(*) FROM facts WHERE NOT stale AND votes >= 3 UNION ALL SELECT 'typed', count(*) FROM facts WHERE NOT stale AND votes >= 3 AND rel_type IS NOT NULL"""
)
def relation_funnel(spark, sf_dir):
    """Counts of every stage from one pass over the facts."""
    fresh = ~F.col("stale")
    tests = {"all": F.lit(True), "fresh": fresh, "voted": fresh & F.col("votes").isNotNull(), "confirmed": fresh & (F.col("votes") >= 3), "typed": fresh & (F.col("votes") >= 3) & F.col("rel_type").isNotNull()}
    counts = facts(spark, sf_dir).agg(*[F.count(F.when(t, 1)).alias(s) for s, t in tests.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in tests])).alias("x")).select("x.stage", "x.n")


@query(f"WITH {FACTS} SELECT kind, key, count(*) AS n FROM (SELECT 'src' AS kind, src AS key FROM facts UNION ALL SELECT 'dst', dst FROM facts UNION ALL SELECT 'type', coalesce(rel_type, 'none') FROM facts) GROUP BY kind, key")
def graph_composition(spark, sf_dir):
    f = facts(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.lit("none")).alias("key")) for k, c in (("src", "src"), ("dst", "dst"), ("type", "rel_type"))])).alias("x"))
    return f.select("x.kind", "x.key").groupBy("kind", "key").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS rn FROM part) WHERE rn <= 5")
def stratified_sample(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_partkey")
    return S.top_per_group(parts, "brand", [F.md5(F.col("p_partkey").cast("string").cast("binary")), F.col("p_partkey")], 5).select("brand", "p_partkey")


@query(
    """SELECT name, n, CASE WHEN n >= 300 THEN 3 WHEN n >= 150 THEN 2 ELSE 1 END AS tier, sources FROM (
SELECT lang || '/' || (doc_id % 3) AS name, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1)"""
)
def summary_tiers(spark, sf_dir):
    grouped = table(spark, sf_dir, "documents").groupBy(F.concat("lang", F.lit("/"), (F.col("doc_id") % 3).cast("string")).alias("name")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
    return grouped.select("name", "n", F.when(F.col("n") >= 300, 3).when(F.col("n") >= 150, 2).otherwise(1).alias("tier"), "sources")
