"""SimHash document fingerprints in DataFrame functions only.

Terms are pairs of neighbouring words (A-Z lower-cased; the first word also
pairs with the start of the text).  A term votes with two 64-bit hashes for the
signed bits of a 128-bit fingerprint; its weight is the length of its words, at
most `HEAVIEST` bytes, so that pairs of function words say little.  A bit is set
when over half the weight set it.  Equal texts have equal fingerprints, a text
without words has fingerprint zero, and the likeness of two fingerprints is the
share of equal bits.

`within_radius` finds all fingerprints within a Hamming radius by permuted block
tables: the bits are cut into radius + 2 blocks, and there is a table for every
pair of blocks, keyed by their bits.  Two fingerprints within the radius differ
in at most ``radius`` blocks, so they agree in two and meet in that table; each
match is verified over all bits and given by one table only.  Copies are one entry
with a count, and a crowded key is left to the skew join.

Edge cases: null texts are empty; repeated rows each give a row; ties in the id
follow the text's order; null ids sort first; a single document is its own next
one; an empty table gives an empty table; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoframe.llm.common import ascii_lower, materialize, table, text_or_empty, vote_columns, vote_names, voted_bits, words

HEAVIEST = 24
#: Terms that are counted together in 16 bits, of which the uppermost is the sign: PART_TERMS * HEAVIEST < 2**15.
PART_TERMS = 1024
#: Documents that are put in order together.
RUN_ROWS = 4000
#: Bits in which fingerprints of the contract's search may differ.
RADIUS = 3
#: Quantiles of the ids that are fetched to cut them into runs.
QUANTILES = 512


def _terms(text: Column) -> Column:
    """Array of (one, two, weight): both hashes and the weight of every term."""
    w = words(ascii_lower(text))
    before = F.concat(F.array(F.lit("")), w)
    pair = lambda a, b: F.struct(F.xxhash64(a, b).alias("one"), F.xxhash64(b, F.lit(1), a).alias("two"), F.least(F.octet_length(a) + F.octet_length(b), F.lit(HEAVIEST)).cast("long").alias("weight"))
    return F.zip_with(F.slice(before, 1, F.size(w)), w, pair)


def simhash128(df: DataFrame, keys: list[str], text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` with their text's fingerprint as two longs, hi and lo.

    ``keys`` must tell the rows apart; ``keep`` names columns of numbers that go along.
    """
    rows = df.select(*keys, *keep, F.posexplode_outer(_terms(text_or_empty(text_col))).alias("__at", "__t"))
    part = F.coalesce(F.floor(F.col("__at") / PART_TERMS), F.lit(0)).alias("__part")
    flat = rows.select(*keys, *keep, part, "__t.one", "__t.two", "__t.weight")
    sums = [*vote_columns(F.col("one"), F.col("weight"), 4, "__a"), *vote_columns(F.col("two"), F.col("weight"), 4, "__b"), F.sum("weight").alias("__n")]
    parts = flat.groupBy(*keys, "__part").agg(*sums, *[F.max(k).alias(k) for k in keep])
    longs = F.collect_list(F.array(*vote_names(4, "__a"), *vote_names(4, "__b"))).alias("__v")
    votes = parts.groupBy(*keys).agg(longs, F.sum("__n").alias("__n"), *[F.max(k).alias(k) for k in keep])
    return votes.select(*keys, *keep, voted_bits(F.col("__v"), F.col("__n"), 4).alias("hi"), voted_bits(F.col("__v"), F.col("__n"), 4, 16).alias("lo"))


def as_hex(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def _masks(radius: int) -> list[list[tuple[str, int]]]:
    """The (column, mask) parts of each of the radius + 2 blocks, counted from lo's lowest bit."""
    blocks = radius + 2
    edges = [128 * k // blocks for k in range(blocks + 1)]
    out = []
    for a, b in zip(edges, edges[1:]):
        parts = []
        for name, base in (("lo", 0), ("hi", 64)):
            x, y = max(a, base) - base, min(b, base + 64) - base
            if x < y:
                mask = (1 << y) - (1 << x)
                parts.append((name, mask - (1 << 64) if mask >> 63 else mask))
        out.append(parts)
    return out


def _matches(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """(qh, ql, hi, lo, n, distance) of every two fingerprints within ``radius`` bits, once.

    n counts the rows of ``prints`` that have the fingerprint.  Two fingerprints
    may meet in several tables; the one of the two lowest blocks in which they
    agree gives the pair, so that no shuffle has to remove repeats.
    """
    masks = _masks(radius)
    pairs = list(combinations(range(len(masks)), 2))
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col(c).bitwiseAND(F.lit(m)) for c, m in masks[a] + masks[b]]) for i, (a, b) in enumerate(pairs)])
    keyed = lambda d: d.select("*", F.posexplode(keys).alias("table", "key"))
    q = keyed(queries.groupBy("hi", "lo").agg(F.count("*").alias("n"))).alias("q")
    p = keyed(prints.groupBy("hi", "lo").agg(F.count("*").alias("n"))).alias("p")

    def agree(k: int) -> Column:
        same = [F.col(f"q.{c}").bitwiseXOR(F.col(f"p.{c}")).bitwiseAND(F.lit(m)) == 0 for c, m in masks[k]]
        return reduce(Column.__and__, same)

    first = F.lit(False)
    for i, (a, b) in enumerate(pairs):
        here = reduce(Column.__and__, [agree(k) if k in (a, b) else ~agree(k) for k in range(b + 1)])
        first = F.when(F.col("p.table") == i, here).otherwise(first)
    apart = distance(F.col("q.hi"), F.col("q.lo"), F.col("p.hi"), F.col("p.lo"))
    met = (F.col("q.table") == F.col("p.table")) & (F.col("q.key") == F.col("p.key")) & (apart <= radius) & first
    return q.join(p, met).select(F.col("q.hi").alias("qh"), F.col("q.lo").alias("ql"), "p.hi", "p.lo", "p.n", apart.alias("distance"))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int, id_col: str = "doc_id") -> DataFrame:
    """(query, id, distance) of every pair of a query and a print within ``radius`` bits.

    Both have ``id_col``, hi and lo.  Copies of a fingerprint are searched once.
    """
    met = _matches(queries, prints, radius).drop("n")
    named = queries.select(F.col(id_col).alias("query"), F.col("hi").alias("qh"), F.col("lo").alias("ql"))
    return met.join(named, ["qh", "ql"]).join(prints.select(id_col, "hi", "lo"), ["hi", "lo"]).select("query", id_col, "distance")


def counts_within(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """(hi, lo, n_within): of each of the queries' fingerprints, the rows of ``prints`` within ``radius`` bits.

    Copies stay collapsed, and matches are summed before they are shuffled.
    """
    met = _matches(queries, prints, radius)
    return met.groupBy(F.col("qh").alias("hi"), F.col("ql").alias("lo")).agg(F.sum("n").alias("n_within"))


def in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row with its place (run, at) by ascending id, and the next row's text and place.

    Runs are cut at quantiles of the ids, and evenly between these, so that a
    run has about RUN_ROWS rows and no task orders the whole table.  A run's
    first rows also stand at the end of the run before, where they are next.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    many, cuts = rows.agg(F.count("*"), F.percentile_approx("id", [k / QUANTILES for k in range(QUANTILES + 1)], 100_000)).first()
    cuts = sorted(set(cuts or [0]))
    within = max(1, -(-many // (RUN_ROWS * len(cuts))))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    width = F.array(*[F.lit(max(1, -(-(b - a) // within))).cast("long") for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1])])
    if many <= RUN_ROWS * 2:
        run = F.lit(0).cast("long")
    else:
        group = max(1, RUN_ROWS * len(cuts) // max(many, 1)) if within == 1 else 1
        place = F.greatest(F.size(F.filter(bounds, lambda c: c <= F.col("id"))), F.lit(1))
        inner = F.least(F.floor((F.col("id") - F.element_at(bounds, place)) / F.element_at(width, place)), F.lit(within - 1))
        run = F.when(F.col("id").isNull(), F.lit(-1).cast("long")).otherwise(F.floor((place * within + F.greatest(inner, F.lit(0))) / group))
    rows = rows.withColumn("run", run)
    heads = rows.groupBy("run").agg(F.min("id").alias("head"))
    ring = Window.orderBy("run")
    last = heads.agg(F.max("run")).first()[0]
    heads = heads.withColumn("before", F.coalesce(F.lag("run").over(ring), F.lit(last)))
    if heads.count() <= 1_000_000:
        heads = F.broadcast(heads)
    home = F.struct(F.col("run").alias("run"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("run"), F.lit(True).alias("guest"))
    marked = rows.join(heads.withColumnRenamed("run", "of"), F.col("run") == F.col("of"), "left")
    placed = marked.select("id", "text", F.col("run").alias("own"), F.explode(F.when(F.col("id").eqNullSafe(F.col("head")), F.array(home, guest)).otherwise(F.array(home))).alias("p")).select("id", "text", "own", "p.run", "p.guest")
    order = Window.partitionBy("run").orderBy("guest", F.col("id").asc_nulls_first(), "text")
    at = F.row_number().over(order)
    seen = placed.select(
        "run", "guest", "id", "text", at.alias("at"), F.lead("text").over(order).alias("next_text"), F.lead("guest").over(order).alias("__g"), F.lead("own").over(order).alias("__o")
    )
    return seen.where(~F.col("guest")).select("run", "at", "id", "text", "next_text", F.when(F.col("__g"), F.col("__o")).otherwise(F.col("run")).alias("next_run"), F.when(F.col("__g"), F.lit(1)).otherwise(F.col("at") + 1).alias("next_at"))


def edited_fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, asked: Callable[[Column], Column] | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next text, compared.

    The edited text has its last floor(n / 2) code points replaced by as many of
    the next document's first, or all of them if it has fewer.  ``asked`` tells by
    the id which rows the block tables are searched for: n_within counts the other
    rows whose text's fingerprint is within ``radius`` bits, null for rows not asked.
    """
    rows = in_order(df, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    sha = F.sha2(edited, 256)
    longs = [F.conv(F.substring(sha, 1 + 16 * k, 16), 16, -10).cast("long").alias(f"sha{k}") for k in range(4)]
    both = rows.select("run", "at", "id", "next_run", "next_at", n.cast("long").alias("n_chars"), *longs, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), edited.alias("t")))).alias("v"))
    flat = both.select("run", "at", F.col("v.kind").alias("kind"), "id", "next_run", "next_at", "n_chars", *[f"sha{k}" for k in range(4)], F.col("v.t").alias("t"))
    keep = ("id", "next_run", "next_at", "n_chars", *[f"sha{k}" for k in range(4)])
    prints = simhash128(flat, ["run", "at", "kind"], "t", keep)
    pick = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = prints.groupBy("run", "at").agg(*[F.max(k).alias(k) for k in keep], pick("hi", 0).alias("hi"), pick("lo", 0).alias("lo"), pick("hi", 1).alias("ehi"), pick("lo", 1).alias("elo"))
    wide = materialize(wide, "prints")
    after = wide.select(F.col("run").alias("next_run"), F.col("at").alias("next_at"), F.col("hi").alias("nhi"), F.col("lo").alias("nlo"))
    like = lambda a, b: F.lit(1.0) - distance(F.col("hi"), F.col("lo"), F.col(a), F.col(b)) / F.lit(128.0)
    out = wide.join(after, ["next_run", "next_at"])
    found = []
    if asked is not None:
        queries = wide.where(asked(F.col("id"))).select("next_run", "next_at", "hi", "lo")
        counts = counts_within(queries, wide.select("hi", "lo"), radius)
        # A row's next place is its own too, so this join finds the rows where the last one left them.
        out = out.join(queries.join(counts, ["hi", "lo"]).select("next_run", "next_at", "n_within"), ["next_run", "next_at"], "left")
        found = [(F.col("n_within") - 1).alias("n_within")]
    return out.select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col),
        "n_chars",
        F.lower(F.concat(*[F.lpad(F.hex(f"sha{k}"), 16, "0") for k in range(4)])).alias("edited_sha256"),
        as_hex(F.col("hi"), F.col("lo")).alias("fingerprint"),
        as_hex(F.col("ehi"), F.col("elo")).alias("edited_fingerprint"),
        like("ehi", "elo").alias("near_edited"),
        like("nhi", "nlo").alias("near_next"),
        *found,
    )


def op6_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents; the searched ones are those whose id is divisible by 100."""
    return edited_fingerprints(table(spark, sf_dir, "documents"), asked=lambda i: i % 100 == 0)
