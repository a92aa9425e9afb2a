"""Relations of the engine's data model, made from the synthetic tables.

``documents`` split at line ends are chunks; line items are quoted facts between
suppliers and parts, with orders as their documents; customers, nations and
regions are a hierarchy of areas.  Every relation has the same definition as a
DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = """chunks AS (
  SELECT doc_id, CAST(ord AS INTEGER) AS ord, text, CAST(length(text) AS INTEGER) AS n_chars, source, lang FROM (
    SELECT doc_id, source, lang, unnest(range(len(parts))) AS ord, unnest(parts) AS text
    FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents)))"""

FACTS = """facts AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS doc_id, l_orderkey * 8 + l_linenumber AS chunk_id,
    'S' || l_suppkey AS src, CASE l_returnflag WHEN 'A' THEN 'contains' WHEN 'N' THEN 'located in' ELSE 'formed by' END AS relation,
    'P' || (l_partkey % 200) AS dst,
    CASE WHEN l_linenumber >= 6 THEN NULL ELSE CAST(l_quantity AS INTEGER) % 5 END AS votes,
    l_linestatus = 'F' AND l_linenumber = 2 AS stale, l_linenumber <> 3 AS typed,
    CASE WHEN l_linenumber IN (3, 4) THEN NULL ELSE CASE WHEN l_linenumber = 5 THEN 'part_of' ELSE 'host' END END AS rel_type
  FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, text, n_chars, source, lang."""
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    return parts.select("doc_id", "ord", "text", F.length("text").alias("n_chars"), "source", "lang")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, doc_id, chunk_id, src, relation, dst, votes, stale, typed, rel_type."""
    line = F.col("l_linenumber")
    key = F.col("l_orderkey") * 8 + line
    return table(spark, sf_dir, "lineitem").select(
        key.alias("id"),
        F.col("l_orderkey").alias("doc_id"),
        key.alias("chunk_id"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("src"),
        F.when(F.col("l_returnflag") == "A", "contains").when(F.col("l_returnflag") == "N", "located in").otherwise("formed by").alias("relation"),
        F.concat(F.lit("P"), F.col("l_partkey") % 200).alias("dst"),
        F.when(line < 6, F.col("l_quantity").cast("int") % 5).alias("votes"),
        ((F.col("l_linestatus") == "F") & (line == 2)).alias("stale"),
        (line != 3).alias("typed"),
        F.when(~line.isin(3, 4), F.when(line == 5, "part_of").otherwise("host")).alias("rel_type"),
    )
