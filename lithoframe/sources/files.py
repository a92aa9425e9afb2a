"""Readers of the engine's file formats; all through Spark's own sources, so any file system works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoframe.functions.text import slug

CHUNK_SCHEMA = "doc_id string, index int, text string, embed_text string, headings array<string>, pages array<int>, n_tokens int, has_table boolean, source_path string"
AREA_SCHEMA = "area_id string, canonical_name string, level string, parent_ids string, country string, deposit_types string, settings string, overlaps string, basis string, basis_doc_id string, basis_quote string, review_status string"


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of ``<doc_id>.chunks.json`` files, one row each; an unreadable file gives one row with ``error``."""
    raw = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.chunks.json").load(folder)
    named = raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.chunks\.json$", 1).alias("file_id"), "value")
    parsed = named.withColumn("rows", F.from_json("value", f"array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in CHUNK_SCHEMA.split(', '))}>>"))
    bad = F.col("rows").isNull()
    out = parsed.select("file_id", F.when(bad, "unreadable").when(F.size("rows") == 0, "empty").alias("error"), F.explode_outer("rows").alias("r"))
    return out.select("file_id", "error", "r.*")


def document_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Metadata of ``<doc_id>.json`` files beside the chunks, with ``file_id``; broken ones have null columns."""
    raw = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(folder)
    named = raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("file_id"), "value").where(~F.endswith("file_id", F.lit(".chunks")))
    return named.select("file_id", F.from_json("value", schema).alias("r")).select("file_id", "r.*")


def journal(spark: SparkSession, path: str, schema: str, key: str = "doc_id") -> DataFrame:
    """The last record of every key of a JSONL journal; broken lines are skipped.

    Lines are ordered by their place in the file.
    """
    lines = spark.read.format("text").option("wholetext", True).load(path)
    each = lines.select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    rows = each.select("file", "line", F.from_json("value", schema).alias("r")).where(F.col(f"r.{key}").isNotNull())
    last = rows.withColumn("rn", F.row_number().over(Window.partitionBy(f"r.{key}").orderBy(F.desc("file"), F.desc("line")))).where("rn = 1")
    return last.select("r.*")


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """One term a line; empty lines and ``#`` comments out."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where((F.col("term") != "") & ~F.startswith("term", F.lit("#")))


def registry(spark: SparkSession, areas: str, aliases: str) -> tuple[DataFrame, DataFrame, str]:
    """Areas with list columns, aliases, and a version that changes with either file."""
    a = spark.read.option("header", True).option("multiLine", True).csv(areas)
    for c in ("parent_ids", "deposit_types", "settings", "overlaps"):
        if c in a.columns:
            a = a.withColumn(c, F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""))
    b = spark.read.option("header", True).csv(aliases)
    files = spark.read.format("binaryFile").load([areas, aliases]).select(F.sha2("content", 256).alias("h"))
    version = files.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256)).first()[0]
    return a, b, version


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSONL dictionary, with the order of their lines."""
    schema = "term string, en string, etym string, definition string, page int"
    rows = spark.read.format("text").option("wholetext", True).load(path).select(F.posexplode(F.split("value", "\n")).alias("ord", "value"))
    return rows.select("ord", F.from_json("value", schema).alias("r")).where("r.term IS NOT NULL").select("ord", "r.*")


def folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder with size, SHA-256 and an id of name and hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    digest = F.sha2("content", 256)
    return files.select("path", F.col("length").alias("bytes"), digest.alias("sha256"), F.concat(slug(name), F.lit("-"), F.substring(digest, 1, 10)).alias("doc_id"))


def table_by_headers(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",") -> DataFrame:
    """A CSV table whose columns are recognised by the first letters of their headers."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    chosen = {}
    for c in raw.columns:
        for name, prefix in columns.items():
            if name not in chosen and c.strip().lower().startswith(prefix.lower()):
                chosen[name] = c
                break
    return raw.select(*[F.col(f"`{c}`").alias(n) for n, c in chosen.items()])


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set as JSON lines: id, question, keyword groups ``a|b`` and expected documents; ids are unique."""
    rows = spark.read.schema("id string, question string, keywords array<string>, documents array<string>, control boolean").json(path)
    split = F.transform("keywords", lambda k: F.transform(F.split(k, r"\|"), lambda x: F.trim(x)))
    out = rows.withColumn("keywords", split)
    twice = out.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"question id {twice[0].id!r} is used twice")
    return out


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, canon) of a JSON-lines dictionary of canon and its variants; the first canon of a key wins."""
    rows = spark.read.format("text").option("wholetext", True).load(path).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    each = rows.select("line", F.from_json("value", "section string, canon string, variants array<string>").alias("r")).where("r.canon IS NOT NULL")
    keys = each.select("line", "r.section", "r.canon", F.explode(F.array_union(F.array("r.canon"), F.coalesce("r.variants", F.array().cast("array<string>")))).alias("v"))
    return keys.groupBy("section", F.lower(F.trim("v")).alias("key")).agg(F.min_by("canon", "line").alias("canon"), F.count_distinct("canon").alias("canons"))


def snapshot(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their ordered chunks as one array; a missing parser_version is null."""
    if "parser_version" not in documents.columns:
        documents = documents.withColumn("parser_version", F.lit(None).cast("string"))
    parts = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("chunks"))
    return documents.join(parts, "doc_id", "left")
