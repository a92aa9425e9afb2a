"""Queries of the vector index and of the cosine join."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from lithoframe.operators import cosine_join as C
from lithoframe.operators import linking as L
from lithoframe.operators import vector_index as V
from lithoframe.operators.sparse_join import sparse_join
from lithoframe.plans.catalog import query
from lithoframe.plans.retrieval import _NEAR, _first, _vectors
from lithoframe.plans.scratch import new_path
from lithoframe.plans.views import table


def _index(spark, sf_dir):
    return V.build_index(_vectors(spark, sf_dir), new_path(spark, "vectors"))


@query(f"WITH {_NEAR} SELECT id, doc_id, similarity, CAST(pos AS INTEGER) AS pos FROM near WHERE pos <= 20")
def index_top_k(spark, sf_dir):
    """The nearest 20 from the index, exactly: cells are read until none can hold a nearer one."""
    return _index(spark, sf_dir).search(_first(spark, sf_dir), 20, exact=True)


@query(f"WITH {_NEAR.replace('q))', 'q WHERE e.label IN (3, 7)))')} SELECT id, doc_id, similarity, CAST(pos AS INTEGER) AS pos FROM near WHERE pos <= 15")
def index_filtered_top_k(spark, sf_dir):
    return _index(spark, sf_dir).search(_first(spark, sf_dir), 15, where=F.col("doc_id").isin(3, 7), exact=True)


@query()
def index_neighbours(spark, sf_dir):
    """The ten nearest of every stated query (ids divisible by 100) in the cells that the index probes."""
    vectors = _vectors(spark, sf_dir)
    return _index(spark, sf_dir).neighbours(vectors.where("id % 100 = 0"), 10)


DIMS = 256


def trigram_counts(names: list[str]) -> list[list[float]]:
    """Counts of a name's hashed letter trigrams."""
    out = []
    for name in names:
        v, low = [0.0] * DIMS, f" {name.lower()} "
        for k in range(len(low) - 2):
            v[hashlib.md5(low[k : k + 3].encode(), usedforsecurity=False).digest()[0]] += 1.0
        out.append(v)
    return out


def _names(spark, sf_dir):
    """Client names with their number of rows and their vectors."""
    names = table(spark, sf_dir, "clients").where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("times"))
    return names.select(F.col("name").alias("id"), "name", "times", L.embedder(trigram_counts, 1024)("name").alias("v"))


_PAIRS = """names AS (SELECT name AS id, count(*) AS times FROM clients WHERE name IS NOT NULL GROUP BY name),
grams AS (SELECT id, CAST('0x' || substr(md5(substr(' ' || lower(id) || ' ', k, 3)), 1, 2) AS INTEGER) AS d, count(*)::DOUBLE AS n FROM (SELECT id, CAST(unnest(range(1, length(id) + 1)) AS INTEGER) AS k FROM names) GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(n * n)) AS norm FROM grams GROUP BY id),
vectors AS (SELECT id, list((d, n) ORDER BY d) AS v FROM grams GROUP BY id),
same AS (SELECT id, min(id) OVER (PARTITION BY v) AS rep FROM vectors),
pairs AS (SELECT a, b, round(dot / p.norm / q.norm, 6) AS similarity FROM (
    SELECT x.id AS a, y.id AS b, sum(x.n * y.n) AS dot FROM grams x JOIN same s ON s.id = x.id AND s.rep = x.id JOIN grams y ON x.d = y.d AND x.id < y.id JOIN same t ON t.id = y.id AND t.rep = y.id GROUP BY 1, 2)
  JOIN norms p ON p.id = a JOIN norms q ON q.id = b WHERE round(dot / p.norm / q.norm, 6) >= 0.8)"""


@query(f"WITH {_PAIRS} SELECT a, b, similarity FROM pairs")
def similar_spellings(spark, sf_dir):
    """Pairs of client names with cosine of at least 0.8 over letter trigrams, one name for each vector."""
    names = C.materialize(_names(spark, sf_dir), "names")
    return sparse_join(C.distinct_vectors(names, vector_col="v"), 0.8)


_GUARD = r"list_sort(list_distinct(regexp_extract_all(lower({}), '(\d+|[α-ω]|\b(?:north|south|east|west|upper|lower)\w*)')))"


@query(
    f"""WITH RECURSIVE {_PAIRS}, frequent AS (SELECT s.rep AS id, CAST(sum(times) AS BIGINT) AS times FROM names JOIN same s ON s.id = names.id GROUP BY s.rep),
both_ AS (SELECT a AS id, b AS near, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs),
close AS (SELECT c.id, c.near, c.similarity, row_number() OVER (PARTITION BY c.id ORDER BY c.similarity DESC, g.times DESC, c.near) AS rn
  FROM both_ c JOIN frequent f ON f.id = c.id JOIN frequent g ON g.id = c.near WHERE g.times > f.times OR (g.times = f.times AND g.id < f.id)),
chosen AS (SELECT id, arg_min(near, rn) AS near, arg_min(similarity, rn) AS similarity FROM close WHERE rn <= 5 AND {_GUARD.format("id")} = {_GUARD.format("near")} GROUP BY id),
walk AS (SELECT id, id AS at, 0 AS n FROM frequent UNION ALL SELECT w.id, c.near, w.n + 1 FROM walk w JOIN chosen c ON c.id = w.at)
SELECT w.id, arg_max(w.at, w.n) AS canon, any_value(c.similarity) AS similarity FROM walk w LEFT JOIN chosen c ON c.id = w.id GROUP BY w.id"""
)
def name_synonyms(spark, sf_dir):
    """Client names merged into more frequent ones that are spelled almost alike."""
    names = C.materialize(_names(spark, sf_dir), "names")
    spellings = C.materialize(names.groupBy("v").agg(F.min("id").alias("id"), F.sum("times").alias("times")).withColumn("name", F.col("id")), "spellings")
    return C.merge_names(spellings, C.materialize(sparse_join(spellings, 0.8), "pairs"), L.merge_guard(F.col("name"), F.col("other")))
