"""Queries of almost equal names and of the stored word index.

Vendors are places that are asked for among the names of clients.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.functions.text import translit_key
from lithoframe.operators import fuzzy_names as N
from lithoframe.operators import words as W
from lithoframe.operators.stored_words import WordIndex
from lithoframe.plans.catalog import query
from lithoframe.plans.retrieval import _HYBRID, _WORDS, _first, _texts, _vectors, _words_cte
from lithoframe.plans.scratch import new_path
from lithoframe.plans.text_columns import _KEY
from lithoframe.plans.upkeep import _SPACED, _scored
from lithoframe.plans.views import table

#: Likeness in SQL: of each pair of parts the longest common run, first in the one and then in the other, and the parts on both sides of it.
_CODES = "flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(x) - i + 2), lambda n: n * 1000 + 999 - i)))"
_BEST = f"list_max(list_filter({_CODES}, lambda c: contains(y, substr(x, 999 - c % 1000, c // 1000))))"
_LETTERS = "list_reduce(list_transform(list_distinct(string_split(a, '')), lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, '')))), lambda s, t: s + t)"
_ALIKE = f"""vendor_keys AS (SELECT vendor_id, {_KEY.replace('n_name', 'name')} AS key FROM vendors), client_keys AS (SELECT name, {_KEY.replace('n_name', 'name')} AS key FROM (SELECT DISTINCT name FROM clients)),
near_keys AS (SELECT a, b FROM (SELECT DISTINCT key AS a FROM vendor_keys WHERE key <> '') CROSS JOIN (SELECT DISTINCT key AS b FROM client_keys WHERE key <> '') WHERE 2 * {_LETTERS} >= 0.85 * (length(a) + length(b))),
parts AS (SELECT a, b, x, y, {_BEST} AS c FROM (SELECT a, b, a AS x, b AS y FROM near_keys) UNION ALL
  SELECT a, b, x, y, {_BEST} FROM (SELECT a, b, s.x AS x, s.y AS y FROM (SELECT a, b, unnest([{{'x': substr(x, 1, i - 1), 'y': substr(y, 1, j - 1)}}, {{'x': substr(x, i + n, 1000), 'y': substr(y, j + n, 1000)}}]) AS s
    FROM (SELECT a, b, x, y, 999 - c % 1000 AS i, c // 1000 AS n, strpos(y, substr(x, 999 - c % 1000, c // 1000)) AS j FROM parts WHERE c IS NOT NULL)))),
alike AS (SELECT a, b, 2.0::DOUBLE * sum(c // 1000) / (length(a) + length(b)) AS ratio FROM parts GROUP BY a, b HAVING 2.0 * sum(c // 1000) / (length(a) + length(b)) >= 0.85)"""


@query(f"WITH RECURSIVE {_ALIKE} SELECT a, b, round(ratio, 6) AS ratio FROM alike")
def alike_names(spark, sf_dir):
    """Keys of vendors' names with the almost equal keys of clients' names."""
    vendors, clients = table(spark, sf_dir, "vendors"), table(spark, sf_dir, "clients")
    keys = lambda df: df.select(translit_key(F.col("name")).alias("key"))
    return N.alike_keys(keys(vendors), keys(clients)).withColumn("ratio", F.round("ratio", 6))


@query(
    f"""WITH RECURSIVE {_ALIKE} SELECT place, name, score, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, name) AS INTEGER) AS pos
FROM (SELECT vendor_id AS place, c.name, round(max(ratio), 6) AS score FROM alike JOIN vendor_keys v ON v.key = a JOIN client_keys c ON c.key = b GROUP BY 1, 2) QUALIFY pos <= 4"""
)
def resolved_places(spark, sf_dir):
    """At most four client names for each vendor, the closest first."""
    asked = table(spark, sf_dir, "vendors").select(F.col("vendor_id").alias("place"), F.col("name").alias("spelling"))
    return N.resolve_places(table(spark, sf_dir, "clients").select("name"), asked)


def _grown(spark, sf_dir, texts) -> WordIndex:
    """An index of ``texts`` that came in two batches: first two thirds, some with an older text, then all."""
    index = WordIndex(spark, new_path(spark, "words"))
    third = F.pmod(F.xxhash64("id"), F.lit(3))
    older = F.when(F.pmod(F.xxhash64("id"), F.lit(7)) == 0, F.concat(F.lit("the and of the older text "), "text")).otherwise(F.col("text"))
    index.add(texts.where(third < 2).select("id", older.alias("text")))
    index.add(texts)
    return index


@query(f"WITH {_words_cte(_WORDS)} SELECT id, score, CAST(pos AS INTEGER) AS pos FROM words WHERE pos <= 20")
def stored_keyword_search(spark, sf_dir):
    """`keyword_search` from the stored index."""
    return _grown(spark, sf_dir, _texts(spark, sf_dir)).top(_WORDS, 20)


@query(_HYBRID)
def stored_hybrid_search(spark, sf_dir):
    """`hybrid_search` with keywords from the stored index."""
    return _grown(spark, sf_dir, _texts(spark, sf_dir)).hybrid(_vectors(spark, sf_dir), _first(spark, sf_dir), _WORDS, min_similarity=0.1)


@query(f"WITH {_SPACED} SELECT id, CAST({_scored(chr(39) + 'of' + chr(39), chr(39) + 'the' + chr(39))} AS DOUBLE) AS score FROM t WHERE contains(t, ' of the ') AND NOT contains(t, ' with ') ORDER BY score DESC, id LIMIT 50")
def stored_phrase_search(spark, sf_dir):
    """A phrase and an excluded word from the stored index after a merge."""
    index = _grown(spark, sf_dir, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    index.merge()
    return index.search(W.parse('"of the" -with'), 50)
