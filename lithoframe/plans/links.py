"""Queries of names in texts and of the remaining relational idioms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lithoframe.functions import rules as R
from lithoframe.operators import linking as L
from lithoframe.operators import search as S
from lithoframe.operators.cosine_join import exact_join
from lithoframe.plans.catalog import query
from lithoframe.plans.views import CHUNKS, FACTS, chunks, facts, table

_TERMS = "terms AS (SELECT DISTINCT key, key AS term FROM (SELECT unnest(['the', 'of the', 'in the', 'that', 'and', 'is of', 'to the and']) AS key))"
_LIST = ("the", "of the", "in the", "that", "and", "is of", "to the and")
_RUNS = r"""w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), p AS (SELECT id, w, unnest(range(len(w))) AS at_ FROM w), n AS (SELECT id, at_, k AS n, array_to_string(list_slice(w, at_ + 1, at_ + k), ' ') AS key FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE at_ + k <= len(w)),
h AS (SELECT n.*, t.term FROM n JOIN terms t ON t.key = n.key), r AS (SELECT *, max(at_ + n) OVER (PARTITION BY id ORDER BY at_, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h), l AS (SELECT id, at_, n, term FROM r WHERE reach IS NULL OR at_ + n > reach)"""


def _links(spark, sf_dir):
    terms = spark.createDataFrame([(t, t) for t in _LIST], "key string, term string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.link_terms(docs, terms)


@query(f"WITH {_TERMS}, {_RUNS} SELECT term, count(*) AS hits, count(DISTINCT id) AS texts FROM l GROUP BY term")
def term_links(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("term").agg(F.count("*").alias("hits"), F.count_distinct("id").alias("texts"))


@query(f"WITH {_TERMS}, {_RUNS} SELECT id, count(DISTINCT term) AS terms FROM l GROUP BY id HAVING count(DISTINCT term) >= 4")
def enough_terms(spark, sf_dir):
    return L.distinct_terms_gate(_links(spark, sf_dir), 4)


@query(f"WITH {_TERMS}, {_RUNS} SELECT term, count(DISTINCT id) AS texts FROM l GROUP BY term HAVING count(DISTINCT id) <= 0.5 * (SELECT count(*) FROM w)")
def rare_terms(spark, sf_dir):
    total = table(spark, sf_dir, "documents").count()
    return L.rare_terms(_links(spark, sf_dir), total, 0.5)


@query("WITH s AS (SELECT n_name AS term, CASE n_nationkey % 3 WHEN 0 THEN NULL ELSE lead(n_name) OVER (ORDER BY n_nationkey) END AS see FROM nation), a AS (SELECT t.term, coalesce(s.see, t.term) AS x FROM s t LEFT JOIN s ON s.term = t.term) SELECT a.term, coalesce(s.see, a.x) AS target FROM a LEFT JOIN s ON s.term = a.x")
def followed_terms(spark, sf_dir):
    after = F.lead("n_name").over(Window.orderBy("n_nationkey"))
    s = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.when(F.col("n_nationkey") % 3 != 0, after).alias("see"))
    return L.follow(s.select("term"), s).select("term", "target")


@query("SELECT p_partkey, contains(' ' || lower(p_name) || ' ', ' ' || split_part(lower(p_type), ' ', 1) || ' ') OR split_part(lower(p_name), ' ', 1) = lower(split_part(p_name, ' ', 1)) AS named FROM part")
def mention_test(spark, sf_dir):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", L.mentions(first, F.col("p_name")).alias("named"))


@query(
    f"""WITH {CHUNKS}, c AS (SELECT doc_id, ord, text || ' see Fig. ' || (ord % 4) || ' and figure ' || (doc_id % 3) AS text FROM chunks), f AS (SELECT doc_id, ord, unnest(list_distinct(regexp_extract_all(text, '(?i)\\bfig[a-z]*\\.?\\s*\\(?(\\d+)', 1))) AS number FROM c),
i AS (SELECT doc_id, CAST(k AS VARCHAR) AS number, doc_id * 10 + k AS item FROM documents, (SELECT unnest([1, 2]) AS k)) SELECT f.doc_id, f.ord, f.number, i.item FROM f JOIN i ON i.doc_id = f.doc_id AND i.number = f.number"""
)
def figure_references(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" see Fig. "), (F.col("ord") % 4).cast("string"), F.lit(" and figure "), (F.col("doc_id") % 3).cast("string")))
    items = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("doc_id", F.col("k").cast("string").alias("number"), (F.col("doc_id") * 10 + F.col("k")).alias("item"))
    return L.reference_rows(c, items, "fig").select("doc_id", "ord", "number", "item")


@query(
    f"""WITH {CHUNKS}, o AS (SELECT doc_id, ord, doc_id * 1000 + ord AS id, text FROM chunks), n AS (SELECT doc_id, ord + 1 AS ord, text FROM o WHERE ord % 4 <> 2 UNION ALL SELECT DISTINCT doc_id, 0, 'a new first chunk' FROM o),
oh AS (SELECT *, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM o), nh AS (SELECT *, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM n), ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY ord) AS k FROM oh), nk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY ord) AS k FROM nh),
t AS (SELECT nk.doc_id, nk.ord, ok.id FROM nk LEFT JOIN ok ON ok.doc_id = nk.doc_id AND ok.h = nk.h AND ok.k = nk.k)
SELECT t.doc_id, t.ord, coalesce(t.id, f.id) AS old_id, t.id IS NOT NULL AS same FROM t LEFT JOIN (SELECT * FROM o WHERE id NOT IN (SELECT id FROM t WHERE id IS NOT NULL)) f ON f.doc_id = t.doc_id AND f.ord = t.ord"""
)
def chunk_identity(spark, sf_dir):
    old = chunks(spark, sf_dir).select("doc_id", "ord", (F.col("doc_id") * 1000 + F.col("ord")).alias("id"), "text")
    new = old.where("ord % 4 <> 2").select("doc_id", (F.col("ord") + 1).alias("ord"), "text").unionByName(old.select("doc_id").distinct().select("doc_id", F.lit(0).alias("ord"), F.lit("a new first chunk").alias("text")))
    return L.match_chunks(old, new)


@query(
    """WITH a AS (SELECT o_orderkey AS doc_id, list_distinct(list(l_partkey)) AS authors FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey), k AS (SELECT doc_id, len(authors) AS n, unnest(authors) AS author FROM a)
SELECT x.doc_id AS a, y.doc_id AS b, round(count(*) / least(max(x.n), max(y.n)), 6) AS share FROM k x JOIN k y ON x.author = y.author AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) / least(max(x.n), max(y.n)) >= 0.5"""
)
def author_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set("l_partkey").alias("authors"))
    return L.author_overlap(docs).select("a", "b", F.round("share", 6).alias("share"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE similarity >= 0.45")
def similar_names(spark, sf_dir):
    """All pairs of vectors of at least 0.45, by pairs of blocks."""
    return exact_join(table(spark, sf_dir, "embeddings"), 0.45, id_col="vec_id")


@query(f"WITH {FACTS}, k AS (SELECT 'located in' AS relation, 'AT' AS rel_type, 'S' AS a, 'P' AS b UNION ALL SELECT 'contains', 'HOLDS', 'P', 'S') SELECT f.id, k.rel_type, k.rel_type IS NOT NULL AND k.a = 'P' AS flip FROM facts f LEFT JOIN k ON k.relation = f.relation")
def typed_relations(spark, sf_dir):
    schema = spark.createDataFrame([("located in", "AT", "S", "P"), ("contains", "HOLDS", "P", "S")], "relation string, rel_type string, src_kind string, dst_kind string")
    f = facts(spark, sf_dir).select("id", "relation", F.substring("src", 1, 1).alias("src_kind"), F.substring("dst", 1, 1).alias("dst_kind"))
    return L.type_relations(f, schema).select("id", "rel_type", "flip")


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'gold') AND NOT contains(lower(p_type), 'gold') THEN 'presumably ' || p_type ELSE p_type END AS relation FROM part")
def hedged_relations(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.hedged(F.col("p_type"), F.col("p_name"), "gold").alias("relation"))


@query(
    f"""WITH {FACTS} SELECT id, array_to_string(list_sort(list(DISTINCT partner)), ',') AS partners FROM (SELECT f.id, g.dst AS partner FROM facts f JOIN facts g ON g.src = f.src AND g.doc_id = f.doc_id AND g.dst <> f.dst) GROUP BY id"""
)
def partner_lists(spark, sf_dir):
    """Other ends that the same document states for a fact's source, as an ordered list."""
    f = facts(spark, sf_dir).select("id", "doc_id", "src", "dst")
    met = f.alias("f").join(f.alias("g"), (F.col("f.src") == F.col("g.src")) & (F.col("f.doc_id") == F.col("g.doc_id")) & (F.col("f.dst") != F.col("g.dst")))
    return met.groupBy("f.id").agg(F.array_join(F.array_sort(F.collect_set("g.dst")), ",").alias("partners"))


@query(f"WITH {FACTS}, s AS (SELECT src, dst, relation, min(id) AS id FROM facts GROUP BY ALL) SELECT id, CASE WHEN relation = 'contains' AND NOT EXISTS (SELECT 1 FROM s t WHERE t.src = s.src AND t.dst = s.dst AND t.relation = 'formed by') THEN 'formed by' ELSE relation END AS relation FROM s")
def guarded_relabel(spark, sf_dir):
    """A relation is renamed unless its twin exists."""
    s = facts(spark, sf_dir).groupBy("src", "dst", "relation").agg(F.min("id").alias("id"))
    twin = s.where("relation = 'formed by'").select("src", "dst", F.lit(True).alias("twin"))
    return s.join(twin, ["src", "dst"], "left").select("id", F.when((F.col("relation") == "contains") & F.col("twin").isNull(), "formed by").otherwise(F.col("relation")).alias("relation"))


@query(
    f"""WITH {CHUNKS}, h AS (SELECT doc_id, ord, len(regexp_extract_all(lower(text), 'th')) AS rank FROM chunks WHERE contains(lower(text), 'the ')), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS mentions, max(rank) OVER (PARTITION BY doc_id) AS best, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, ord) AS rn FROM h)
SELECT doc_id, ord, mentions, CAST(rn AS INTEGER) AS rn FROM n WHERE rn <= 2"""
)
def best_chunks_per_article(spark, sf_dir):
    h = chunks(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("the "))).select("doc_id", "ord", F.regexp_count(F.lower("text"), F.lit("th")).alias("rank"))
    every = Window.partitionBy("doc_id")
    ranked = h.withColumn("mentions", F.count("*").over(every)).withColumn("rn", F.row_number().over(every.orderBy(F.desc("rank"), "ord")))
    return ranked.where("rn <= 2").select("doc_id", "ord", "mentions", "rn")


@query(
    f"""WITH {FACTS}, d AS (SELECT src AS name, count(*) AS n FROM facts GROUP BY src), k AS (SELECT f.id, f.doc_id, a.n + b.n AS weight FROM facts f JOIN d a ON a.name = f.src JOIN (SELECT dst AS name, count(*) AS n FROM facts GROUP BY dst) b ON b.name = f.dst)
SELECT id, doc_id, weight, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, id) AS rn FROM k) WHERE rn <= 3"""
)
def facts_under_answer(spark, sf_dir):
    """The heaviest facts of every document."""
    f = facts(spark, sf_dir)
    a = f.groupBy("src").agg(F.count("*").alias("na"))
    b = f.groupBy("dst").agg(F.count("*").alias("nb"))
    weighed = f.join(a, "src").join(b, "dst").select("id", "doc_id", (F.col("na") + F.col("nb")).alias("weight"))
    return S.top_per_group(weighed, "doc_id", [F.desc("weight"), F.col("id")], 3)


@query("SELECT sum(CAST(contains(lower(source), 'src1') AS INTEGER))::BIGINT AS by_title, sum(CAST(NOT contains(lower(source), 'src1') AND contains(lower(text), 'the ') AS INTEGER))::BIGINT AS by_text, count(*) AS docs, round(avg(n_chars), 2) AS mean_chars FROM documents")
def catalog_counts(spark, sf_dir):
    title, text = F.contains(F.lower("source"), F.lit("src1")), F.contains(F.lower("text"), F.lit("the "))
    return table(spark, sf_dir, "documents").agg(F.sum(title.cast("int")).alias("by_title"), F.sum((~title & text).cast("int")).alias("by_text"), F.count("*").alias("docs"), F.round(F.avg("n_chars"), 2).alias("mean_chars"))


@query("SELECT conv_id, turn, text FROM conversations WHERE turn > 0 AND len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')), list_distinct(regexp_extract_all(lower((SELECT min(c.text) FROM conversations c WHERE c.conv_id = conversations.conv_id AND c.turn = conversations.turn - 1)), '[\\p{L}\\p{N}]+')))) / len(list_distinct(list_concat(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), regexp_extract_all(lower((SELECT min(c.text) FROM conversations c WHERE c.conv_id = conversations.conv_id AND c.turn = conversations.turn - 1)), '[\\p{L}\\p{N}]+')))) >= 0.05")
def repeated_queries(spark, sf_dir):
    """Turns that share a twentieth of their words with the turn before."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = t.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("before"))
    return t.join(before, ["conv_id", "turn"]).where(L.fuzzy_repeat(F.col("text"), F.array("before"), 0.05)).select("conv_id", "turn", "text")


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'UNKNOWN' WHEN s_suppkey % 2 = 0 THEN 'EXPLICIT' WHEN s_suppkey % 3 = 0 THEN 'ANAPHORA' ELSE 'TITLE' END AS source, CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'A B' ELSE 'A' END WHEN s_suppkey % 3 = 0 THEN 'C' ELSE 'D' END AS areas, s_suppkey % 5 <> 0 AND s_suppkey % 4 = 0 AS mixed FROM supplier"""
)
def scope_resolution(spark, sf_dir):
    k = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    known = k % 5 != 0
    pick = lambda test, *v: F.when(known & test, F.array(*[F.lit(x) for x in v])).otherwise(none)
    claims = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(known & (k % 4 == 0), F.array(F.lit("B"), F.lit("A"))).otherwise(pick(k % 2 == 0, "A")).alias("quote_areas"), pick(k % 3 == 0, "C").alias("chunk_areas"), none.alias("heading_areas"), pick(F.lit(True), "D").alias("title_areas"))
    return L.resolve_scope(claims).select("s_suppkey", "source", F.array_join("areas", " ").alias("areas"), "mixed")


@query()
def model_answers(spark, sf_dir):
    """A stand-in model over batches: it upper-cases, and fails on batches with long texts, which take the fallback."""

    def model(texts):
        if any(len(t) > 20_000 for t in texts):
            raise ValueError("too long")
        return [t[:10].upper() for t in texts]

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.map_model(docs, model, fallback=F.lit("fallback"))




def _times(pattern):
    return f"len(regexp_extract_all(text, '{pattern}'))"


@query(
    rf"""WITH c AS (SELECT doc_id, {_times(r'\p{L}{2,}')} AS words, {_times(R.WORKPLACES)} AS places, {_times(R.AUTHOR)} AS people, {_times(R.PAGE)} AS pages FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'A. Smith, B. Jones. Institute of Geology, University of Leeds; Department of Earth Sciences. ' || text ELSE text END AS text FROM documents))
SELECT doc_id, words < 150 AND pages < 2 AND ((places >= 3 AND places / greatest(words, 1) >= 0.06) OR (places >= 2 AND (places + people) / greatest(words, 1) >= 0.12)) AS affiliations FROM c"""
)
def affiliation_chunks(spark, sf_dir):
    """Documents, a fifth of them behind a line of authors and places of work."""
    line = F.lit("A. Smith, B. Jones. Institute of Geology, University of Leeds; Department of Earth Sciences. ")
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(line, "text")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text")).select("doc_id", R.is_affiliations(F.col("text")).alias("affiliations"))


@query(
    r"""SELECT p_partkey, len(string_split(p_name, ' ')) <= 3 AND regexp_matches(p_name, '^\p{L}[\p{L}\s''’-]*$') AS usable,
CASE WHEN list_bool_and(list_transform(string_split(lower(p_name), ' '), lambda w: w IN ('ore', 'zone', 'body', 'rock', 'rocks', 'deposit', 'deposits', 'vein', 'veins', 'area', 'field'))) THEN 'generic' END AS problem FROM part"""
)
def name_rules(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", R.usable_in_question(F.col("p_name"), 3).alias("usable"), R.kind_problem(F.col("p_name"), F.lit("thing")).alias("problem"))


@query(f"WITH {FACTS}, g AS (SELECT src, relation, dst, count(DISTINCT doc_id) AS docs FROM facts WHERE src IN ('S1', 'S2') GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY src, relation ORDER BY docs DESC, dst) AS rn FROM g) SELECT src, relation, count(*) AS others, string_agg(dst, ', ' ORDER BY docs DESC, dst) FILTER (WHERE rn <= 15) AS listed FROM n GROUP BY src, relation")
def grouped_summary(spark, sf_dir):
    """By relation, the fifteen strongest other ends in order."""
    g = facts(spark, sf_dir).where("src IN ('S1', 'S2')").groupBy("src", "relation", "dst").agg(F.count_distinct("doc_id").alias("docs"))
    n = g.withColumn("rn", F.row_number().over(Window.partitionBy("src", "relation").orderBy(F.desc("docs"), "dst")))
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= 15, F.struct("rn", "dst")))), lambda x: x.dst)
    return n.groupBy("src", "relation").agg(F.count("*").alias("others"), F.array_join(listed, ", ").alias("listed"))


@query(
    """WITH i AS (SELECT source, lang || (doc_id % 40) AS item, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY n = 1 ORDER BY n DESC, source, item) AS rn FROM i WHERE item <> 'en0') SELECT source, item, n FROM r WHERE n > 1 OR rn <= 25 ORDER BY n DESC, source, item LIMIT 60"""
)
def leftover_items(spark, sf_dir):
    """Items that an answer has not named: at most 25 of a single source, at most 60 in all."""
    i = table(spark, sf_dir, "documents").select("source", F.concat("lang", (F.col("doc_id") % 40).cast("string")).alias("item")).groupBy("source", "item").agg(F.count("*").alias("n")).where("item <> 'en0'")
    order = [F.desc("n"), F.col("source"), F.col("item")]
    r = i.withColumn("rn", F.row_number().over(Window.partitionBy(F.col("n") == 1).orderBy(*order)))
    return r.where("n > 1 OR rn <= 25").orderBy(*order).limit(60).select("source", "item", "n")
