"""Queries of the incremental passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.operators.growing import ComponentIndex, CopyIndex
from lithoframe.plans.catalog import query
from lithoframe.plans.scratch import new_path
from lithoframe.plans.views import FACTS, facts, table
from lithoframe.streaming import passes as P


def _events(spark, sf_dir):
    return P.stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)


@query("SELECT user_id, count(*) AS times, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def ask_counters(spark, sf_dir):
    """How often each user's event came and its newest kind, kept by a stream."""
    target = new_path(spark, "counters")
    P.counter_table(_events(spark, sf_dir), ["user_id"], "event_type", "event_id", target, new_path(spark, "checkpoint"))
    return P.latest_version(spark, target)


@query("SELECT event_id, event_type, value * 2 AS value FROM events WHERE event_type = 'purchase'")
def resumable_pass(spark, sf_dir):
    """Every event is worked on once, over any number of runs."""
    target, checkpoint = new_path(spark, "pass"), new_path(spark, "checkpoint")
    work = lambda b: b.where("event_type = 'purchase'").select("event_id", "event_type", (F.col("value") * 2).alias("value"))
    for _ in range(2):  # the second run finds nothing new
        P.resumable_pass(_events(spark, sf_dir), work, target, checkpoint)
    return spark.read.parquet(target).drop("batch")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    target = new_path(spark, "windows")
    P.windowed_counts(_events(spark, sf_dir), "1 hour", "2 hours", target, new_path(spark, "checkpoint"))
    return P.latest_version(spark, target)


@query(f"WITH {FACTS} SELECT src, relation, dst, count(*) AS facts, max(id) AS last_id FROM facts GROUP BY ALL")
def extended_links(spark, sf_dir):
    """Links of the first facts, extended by the later ones."""
    f = facts(spark, sf_dir)
    first = f.where("doc_id % 3 <> 0").groupBy("src", "relation", "dst").agg(F.count("*").alias("facts"), F.max("id").alias("last_id"))
    return P.extend_links(first, f.where("doc_id % 3 = 0"))


@query(
    """WITH w AS (SELECT o_custkey AS subject, list(o_orderkey) AS chunks, o_custkey % 2 AS version FROM orders GROUP BY o_custkey), c AS (SELECT o_custkey AS subject, list(o_orderkey) AS have, 0 AS version FROM orders WHERE o_orderkey % 20 <> 0 GROUP BY o_custkey)
SELECT w.subject, list_has_all(coalesce(c.have, []), w.chunks) AND coalesce(c.version = w.version, FALSE) AS reuse FROM w LEFT JOIN c ON c.subject = w.subject"""
)
def cached_notes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), "o_orderkey")
    wanted = o.groupBy("subject").agg(F.collect_list("o_orderkey").alias("chunks")).withColumn("version", F.col("subject") % 2)
    cached = o.where("o_orderkey % 20 <> 0").groupBy("subject").agg(F.collect_list("o_orderkey").alias("chunks")).withColumn("version", F.lit(0).cast("long"))
    return P.reuse_notes(wanted, cached)


@query(
    """WITH e AS (SELECT 'u' || user_id AS subject, 0 AS part, count(*) AS weight FROM events WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT 'u' || o_custkey, 1, count(*) FROM orders GROUP BY 1),
f AS (SELECT subject, min((part, -weight)) AS k FROM e GROUP BY subject) SELECT subject, k[1] AS part FROM f ORDER BY k, subject LIMIT 300"""
)
def warm_queue(spark, sf_dir):
    name = lambda c: F.concat(F.lit("u"), F.col(c).cast("string")).alias("subject")
    asked = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(name("user_id")).agg(F.count("*").alias("times"))
    mentioned = table(spark, sf_dir, "orders").groupBy(name("o_custkey")).agg(F.count("*").alias("docs"))
    return P.warm_queue(asked, mentioned, 300)


@query(f"WITH RECURSIVE {FACTS}, e AS (SELECT DISTINCT src AS a, dst AS b FROM facts), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT w.node, x.b FROM walk w JOIN both_ x ON x.a = w.seen) SELECT node, min(seen) AS component FROM walk GROUP BY node")
def growing_components(spark, sf_dir):
    """Components of the facts, which come in three batches of documents."""
    index, f = ComponentIndex(spark, new_path(spark, "components")), facts(spark, sf_dir)
    for number in range(3):
        index.add(f.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == number), "src", "dst")
    return index.current()


@query()
def growing_near_duplicates(spark, sf_dir):
    """Every document with the registered one that it nearly repeats; documents come in four batches by id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index, last, out = CopyIndex(spark, new_path(spark, "copies")), docs.agg(F.max("id")).first()[0] or 0, None
    for number in range(4):
        part = index.add(docs.where(F.floor(F.col("id") * 4 / (last + 1)) == number))
        out = part if out is None else out.unionByName(part)
    return out
