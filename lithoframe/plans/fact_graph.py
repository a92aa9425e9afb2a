"""Queries of the fact graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.operators import communities
from lithoframe.operators import graph as G
from lithoframe.plans.catalog import query
from lithoframe.plans.views import FACTS, facts, table

_NAMES = "names AS (SELECT DISTINCT src AS key, CASE WHEN CAST(substr(src, 2) AS INTEGER) % 10 = 0 THEN 'S1' END AS canon FROM facts), canon AS (SELECT key, canon FROM names WHERE canon IS NOT NULL)"
_CANON = f"""WITH {FACTS}, {_NAMES}, c AS (SELECT f.id, f.doc_id, coalesce(a.canon, f.src) AS s, coalesce(b.canon, f.dst) AS d, f.relation FROM facts f LEFT JOIN canon a ON a.key = f.src LEFT JOIN canon b ON b.key = f.dst),
g AS (SELECT id, doc_id, CASE WHEN relation = 'formed by' THEN d ELSE s END AS src, CASE WHEN relation = 'formed by' THEN 'forms' ELSE relation END AS relation, CASE WHEN relation = 'formed by' THEN s ELSE d END AS dst FROM c WHERE s <> d)"""


def _names(f):
    number = F.substring("src", 2, 20).cast("int")
    return f.where(number % 10 == 0).select(F.col("src").alias("key"), F.lit("S1").alias("canon")).distinct()


def _canonical(spark, sf_dir):
    f = facts(spark, sf_dir)
    relations = spark.createDataFrame([("formed by", "forms", True)], "relation string, canon_relation string, flip boolean")
    return G.canonicalise(f.select("id", "doc_id", "src", "relation", "dst"), _names(f), relations)


@query(f"{_CANON} SELECT src, relation, dst, count(*) AS facts, count(DISTINCT doc_id) AS docs FROM g GROUP BY ALL")
def graph_links(spark, sf_dir):
    return _canonical(spark, sf_dir).groupBy("src", "relation", "dst").agg(F.count("*").alias("facts"), F.count_distinct("doc_id").alias("docs"))


@query(
    f"""{_CANON}, b AS (SELECT src AS name, doc_id, relation FROM g UNION ALL SELECT dst, doc_id, relation FROM g), k AS (SELECT name, first(relation ORDER BY n DESC, relation) AS relation FROM (SELECT name, relation, count(*) AS n FROM b GROUP BY ALL) GROUP BY name)
SELECT b.name, count(*) AS facts, count(DISTINCT doc_id) AS docs, any_value(k.relation) AS relation FROM b JOIN k ON k.name = b.name GROUP BY b.name"""
)
def graph_entities(spark, sf_dir):
    return G.entities(_canonical(spark, sf_dir))


@query("WITH d AS (SELECT 'BUILDING' AS key, 'a' AS canon UNION ALL SELECT 'MACHINERY', 'b'), a AS (SELECT DISTINCT c_mktsegment AS key, lower(c_mktsegment) AS canon FROM customer) SELECT coalesce(d.key, a.key) AS key, coalesce(d.canon, a.canon) AS canon FROM d FULL OUTER JOIN a ON a.key = d.key")
def merged_dictionaries(spark, sf_dir):
    auto = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.lower("c_mktsegment").alias("canon")).distinct()
    return G.merge_dictionaries(spark.createDataFrame([("BUILDING", "a"), ("MACHINERY", "b")], "key string, canon string"), auto)


_AREAS = "areas AS (SELECT 'C' || c_custkey AS child, 'N' || c_nationkey AS parent FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || r_regionkey, 'W' FROM region)"


def areas(spark, sf_dir):
    label = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = table(spark, sf_dir, "customer").select(label("C", "c_custkey").alias("child"), label("N", "c_nationkey").alias("parent"))
    n = table(spark, sf_dir, "nation").select(label("N", "n_nationkey").alias("child"), label("R", "n_regionkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(label("R", "r_regionkey").alias("child"), F.lit("W").alias("parent"))
    return c.unionByName(n).unionByName(r)


@query(f"WITH RECURSIVE {_AREAS}, up AS (SELECT child, parent AS ancestor, 1 AS depth FROM areas UNION ALL SELECT u.child, a.parent, u.depth + 1 FROM up u JOIN areas a ON a.child = u.ancestor) SELECT child, ancestor, depth FROM up")
def hierarchy_closure(spark, sf_dir):
    return G.closure(areas(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {FACTS}, e AS (SELECT DISTINCT src, dst FROM facts WHERE rel_type = 'part_of'), b AS (SELECT src AS node, dst AS t FROM e UNION SELECT dst, src FROM e),
walk AS (SELECT 'S1' AS node, 0 AS level UNION SELECT b.t, w.level + 1 FROM walk w JOIN b ON b.node = w.node WHERE w.level < 3) SELECT node, min(level) AS level FROM walk GROUP BY node"""
)
def subgraph_bfs(spark, sf_dir):
    e = facts(spark, sf_dir).where("rel_type = 'part_of'").select("src", "dst")
    return G.subgraph(e, spark.createDataFrame([("S1",)], "node string"), 3)


_INSIDE = "inside AS (SELECT DISTINCT src AS name FROM facts WHERE src IN ('S1', 'S2') UNION SELECT DISTINCT dst FROM facts WHERE dst IN ('P1', 'P2', 'P3'))"


@query(
    f"""WITH {FACTS}, {_INSIDE}, t AS (SELECT *, src IN (SELECT name FROM inside) AS s, dst IN (SELECT name FROM inside) AS d FROM facts)
SELECT relation, CASE WHEN s THEN '→' ELSE '←' END AS direction, CASE WHEN s THEN dst ELSE src END AS other, count(DISTINCT doc_id) AS docs, count(*) AS fragments FROM t WHERE (s OR d) AND NOT (s AND d AND coalesce(rel_type, '') = 'part_of') GROUP BY ALL"""
)
def entity_dataset(spark, sf_dir):
    inside = spark.createDataFrame([("S1",), ("S2",), ("P1",), ("P2",), ("P3",)], "name string")
    return G.entity_dataset(facts(spark, sf_dir), inside)


@query("SELECT p_partkey, lower(p_name) AS key FROM part WHERE contains(' ' || lower(p_name) || ' ', ' ' || (SELECT split_part(lower(p_name), ' ', 1) FROM part WHERE p_partkey = 1) || ' ')")
def name_containment(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("key"))
    first = names.where("p_partkey = 1").first().key.split(" ")[0]
    return G.contains_name(names, F.lit(first))


@query(f"WITH {FACTS} SELECT doc_id AS chunk_id, count(DISTINCT (src, relation, dst)) AS links, min(id) AS first_id FROM facts GROUP BY doc_id")
def chunk_links(spark, sf_dir):
    return G.chunk_links(facts(spark, sf_dir).withColumn("chunk_id", F.col("doc_id")))


@query(
    f"""WITH {FACTS}, e AS (SELECT src, dst, count(DISTINCT doc_id) AS weight FROM facts GROUP BY ALL ORDER BY weight DESC, src, dst LIMIT 500)
SELECT 'node' AS type, name AS a, CAST(NULL AS VARCHAR) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT src AS name, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY name UNION ALL SELECT 'edge', src, dst, weight FROM e"""
)
def network_rows(spark, sf_dir):
    return G.network(facts(spark, sf_dir), 500)


@query(f"WITH {FACTS} SELECT CASE WHEN src = 'S3' THEN dst ELSE src END AS other, count(DISTINCT doc_id) AS docs FROM facts WHERE src = 'S3' OR dst = 'S3' GROUP BY 1 ORDER BY docs DESC, other LIMIT 15")
def neighbourhood(spark, sf_dir):
    return G.neighbourhood(facts(spark, sf_dir), "S3", 15)


@query(
    f"""WITH {FACTS}, b AS (SELECT src AS name, doc_id FROM facts UNION ALL SELECT dst, doc_id FROM facts), k AS (SELECT name, count(*) AS facts, count(DISTINCT doc_id) AS docs FROM b GROUP BY name),
n AS (SELECT DISTINCT dst AS name FROM facts UNION SELECT 'X' || r_regionkey FROM region) SELECT name, 'no_facts' AS gap, CAST(0 AS BIGINT) AS facts FROM n WHERE name NOT IN (SELECT name FROM k) UNION ALL SELECT name, 'one_source', facts FROM k WHERE facts >= 2 AND docs = 1"""
)
def gap_finder(spark, sf_dir):
    f = facts(spark, sf_dir)
    names = f.select(F.col("dst").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("X"), F.col("r_regionkey").cast("string")).alias("name"))).distinct()
    return G.gaps(f, names, 2)


@query(
    f"""WITH {FACTS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, relation, dst ORDER BY votes DESC NULLS LAST, id) AS rn FROM facts) WHERE rn = 1)
SELECT id, doc_id, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC NULLS LAST, id) AS turn FROM best) WHERE turn <= 2"""
)
def question_candidates(spark, sf_dir):
    return G.question_candidates(facts(spark, sf_dir), 2).select("id", "doc_id", "turn")


_WEAK = f"{FACTS}, e AS (SELECT src AS a, dst AS b, count(DISTINCT doc_id) AS weight FROM facts GROUP BY ALL)"


@query(
    f"""WITH RECURSIVE {_WEAK}, both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT w.node, x.b FROM walk w JOIN both_ x ON x.a = w.seen)
SELECT node, min(seen) AS component FROM walk GROUP BY node"""
)
def components(spark, sf_dir):
    return G.connected_components(facts(spark, sf_dir), "src", "dst")


def _weak_edges(spark, sf_dir):
    return facts(spark, sf_dir).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count_distinct("doc_id").alias("weight"))


@query()
def graph_clusters(spark, sf_dir):
    e = facts(spark, sf_dir).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count_distinct("doc_id").alias("weight"))
    return G.clusters(e)


@query(
    f"""WITH {FACTS}, e AS (SELECT src AS a, dst AS b, count(DISTINCT doc_id) AS weight FROM facts GROUP BY ALL), c AS (SELECT a, b, weight, CAST(substr(a, 2) AS INTEGER) % 4 AS ca, CAST(substr(b, 2) AS INTEGER) % 4 AS cb FROM e),
d AS (SELECT k, sum(weight) AS d FROM (SELECT ca AS k, weight FROM c UNION ALL SELECT cb, weight FROM c) GROUP BY k)
SELECT round(sum(CASE WHEN ca = cb THEN weight ELSE 0 END) / sum(weight) - (SELECT sum(d * d) FROM d) / (4.0::DOUBLE * sum(weight) * sum(weight)), 6) AS modularity FROM c"""
)
def modularity(spark, sf_dir):
    e = facts(spark, sf_dir).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count_distinct("doc_id").alias("weight"))
    ends = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return G.modularity(e, ends.withColumn("cluster", F.substring("node", 2, 20).cast("int") % 4))


@query()
def graph_communities(spark, sf_dir):
    """Communities of at least three names by modularity, over every fact, with titles."""
    e = _weak_edges(spark, sf_dir)
    found = communities.communities(e)
    return found.join(communities.titles(e, found).select("cluster", "title"), "cluster").select("node", "cluster", "size", "title")
