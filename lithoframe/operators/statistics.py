"""Estimates, intervals, rank statistics, resampling and retrieval measures as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of a share; null for n = 0."""
    p = k / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    at = lambda x: F.when(n > 0, x / (1 + z * z / n))
    return at(centre - half), at(centre + half)


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """Newcombe's hybrid interval of the difference of two shares."""
    (l1, u1), (l2, u2) = wilson(k1, n1), wilson(k2, n2)
    p, q = k1 / n1, k2 / n2
    return p - q - F.sqrt((p - l1) * (p - l1) + (u2 - q) * (u2 - q)), p - q + F.sqrt((u1 - p) * (u1 - p) + (q - l2) * (q - l2))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided sign test: twice the smaller tail at p = 1/2, at most 1; n up to 60."""
    small = F.least(k, n - k).cast("int")
    choose = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(1.0), lambda s, j: F.when(i == 0, F.lit(1.0)).otherwise(s * (n - i + j) / j))
    tail = F.aggregate(F.sequence(F.lit(0), small), F.lit(0.0), lambda s, i: s + choose(i))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n)))


def auc(df: DataFrame, score: str, positive: str, groups: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties for a half; by ranks of distinct scores, without pairs.

    Rows are counted for each score first, so the running sum is over distinct
    scores of a group.
    """
    at = df.groupBy(*groups, score).agg(F.count(F.when(F.col(positive), 1)).alias("__p"), F.count(F.when(~F.col(positive), 1)).alias("__n"))
    w = Window.partitionBy(*groups, *([] if groups else [F.lit(0)])).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = at.withColumn("__b", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    won = F.sum(F.col("__p") * (F.col("__b") + F.col("__n") / 2.0))
    return below.groupBy(*groups).agg(F.round(F.try_divide(won, F.sum("__p") * F.sum("__n")), 6).alias("auc"), F.sum("__p").alias("positives"), F.sum("__n").alias("negatives"))


def confusion(df: DataFrame, gold: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Gold by predicted, zero cells included."""
    return df.groupBy(gold).pivot(predicted, list(labels)).count().na.fill(0)


def decision_metrics(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Measures of predicted against gold statuses; columns question, gold and predicted.

    false_target: DIRECT among gold ANALOG and OUT_OF_SCOPE; coverage: questions
    answered DIRECT of those with a gold DIRECT; risk: wrong among predicted
    DIRECT; null where a denominator is 0.
    """
    direct, gold = F.col("predicted") == "DIRECT", F.col("gold") == "DIRECT"
    away = F.col("gold").isin("ANALOG", "OUT_OF_SCOPE")
    count = lambda t: F.count(F.when(t, 1))
    asked, answered = F.count_distinct(F.when(gold, F.col("question"))), F.count_distinct(F.when(gold & direct, F.col("question")))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return df.groupBy(*groups).agg(
        F.count("*").alias("pairs"), ratio(count(away & direct), count(away)).alias("false_target"), ratio(answered, asked).alias("coverage"), ratio(count(direct & ~gold), count(direct)).alias("risk"), ratio(count(gold & direct), count(gold)).alias("recall"),
        ratio(count(F.col("predicted") == "UNRESOLVED"), F.count("*")).alias("unresolved"), ratio(count(F.col("gold") == F.col("predicted")), F.count("*")).alias("accuracy"),
    )


def missing_predictions(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Gold rows without a prediction; metrics are refused unless it is empty."""
    return gold.join(predictions, key, "left_anti")


def retrieval_metrics(runs: DataFrame, wanted: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """top_k, first and reciprocal rank (over distinct documents) of every question.

    ``runs`` has question, doc and pos; ``wanted`` has question and doc.
    """
    first = runs.groupBy("question", "doc").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("pos"))).where(F.col("rank") <= depth)
    hit = ranked.join(wanted.select("question", "doc").distinct(), ["question", "doc"]).groupBy("question").agg(F.min("rank").alias("rank"))
    every = wanted.select("question").distinct().join(hit, "question", "left")
    return every.select("question", F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)).alias("top"), F.coalesce((F.col("rank") == 1).cast("int"), F.lit(0)).alias("first"), F.round(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)), 6).alias("reciprocal"))


def threshold_support(df: DataFrame, score: str, gold: str, thresholds: Sequence[int]) -> DataFrame:
    """tp, fp, fn, tn, precision and recall at every threshold, in one pass."""
    rows = df.select(F.col(score).alias("__s"), F.col(gold).alias("__g"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("k"))
    yes = F.coalesce(F.col("__s") >= F.col("k"), F.lit(False))
    count = lambda t: F.count(F.when(t, 1))
    tp, fp, fn = count(yes & F.col("__g")), count(yes & ~F.col("__g")), count(~yes & F.col("__g"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return rows.groupBy("k").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), count(~yes & ~F.col("__g")).alias("tn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def stratified_share(sample: DataFrame, population: DataFrame, stratum: str, value: str) -> DataFrame:
    """Share of ``value`` in the population, from a sample of each stratum weighted by its size."""
    seen = sample.groupBy(stratum).agg(F.avg(F.col(value).cast("double")).alias("__m"), F.count("*").alias("__k"))
    sizes = population.groupBy(stratum).agg(F.count("*").alias("__n"))
    met = sizes.join(seen, stratum)
    return met.agg(F.round(F.sum(F.col("__m") * F.col("__n")) / F.sum("__n"), 6).alias("share"), F.sum("__n").alias("population"), F.sum("__k").alias("sampled"))


def _poisson(u: Column) -> Column:
    """Poisson(1) quantile of a uniform number."""
    out, cuts = F.lit(7), []
    term, cumulative = 2.718281828459045**-1, 0.0
    for k in range(7):
        cumulative += term
        cuts.append((cumulative, k))
        term /= k + 1
    for c, k in reversed(cuts):
        out = F.when(u < c, F.lit(k)).otherwise(out)
    return out


def bootstrap_mean(df: DataFrame, value: str, cluster: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """Mean and percentile interval, resampling whole clusters.

    Clusters are summed first.  Every cluster then gets a Poisson(1) weight for
    each replicate from a hash of both, so a replicate needs no gathering, any
    partitioning gives the same numbers and only sums are shuffled.
    """
    sums = df.groupBy(cluster).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), F.col(cluster)), F.lit(1 << 30)) / float(1 << 30)
    drawn = sums.select(cluster, "__s", "__n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).withColumn("__w", _poisson(u))
    means = drawn.groupBy("rep").agg((F.sum(F.col("__s") * F.col("__w")) / F.sum(F.col("__n") * F.col("__w"))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return sums.agg((F.sum("__s") / F.sum("__n")).alias("mean")).join(ends, F.lit(True)).select(F.round("mean", 6).alias("mean"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def hash_split(key: Column, dev: int = 30) -> Column:
    """DEV for ``dev`` of 100 keys by their hash, else TEST."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("split|"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < dev, "DEV").otherwise("TEST")


def pooled_precision(runs: DataFrame, judged: DataFrame, k: int = 5) -> DataFrame:
    """Judged, useful and precision of every run's first k, and its share of all useful rows found by any run.

    ``runs`` has run, question, doc and pos; ``judged`` has question, doc and useful.
    """
    top = runs.where(F.col("pos") <= k).join(judged, ["question", "doc"], "left")
    pool = judged.where("useful").agg(F.count("*").alias("__pool"))
    each = top.groupBy("run").agg(F.count("useful").alias("judged"), F.count(F.when(F.col("useful"), 1)).alias("found"))
    return each.join(pool, F.lit(True)).select("run", "judged", "found", F.when(F.col("judged") > 0, F.round(F.col("found") / F.col("judged"), 6)).alias("precision"), F.when(F.col("__pool") > 0, F.round(F.col("found") / F.col("__pool"), 6)).alias("pooled_recall"))


def run_delta(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """Difference of two runs of the same questions; added and removed ones are named."""
    a, b = now.select(key, F.col(value).alias("now")), before.select(key, F.col(value).alias("before"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") > F.col("before"), "better").when(F.col("now") < F.col("before"), "worse").otherwise("same")
    return a.join(b, key, "full_outer").select(key, "now", "before", change.alias("change"))


def paired_outcomes(a: DataFrame, b: DataFrame, key: str, right: str) -> DataFrame:
    """Counts of questions fixed, broken, right in both and wrong in both by the second variant."""
    met = a.select(key, F.col(right).alias("x")).join(b.select(key, F.col(right).alias("y")), key)
    kind = F.when(~F.col("x") & F.col("y"), "fixed").when(F.col("x") & ~F.col("y"), "broken").when(F.col("x"), "both").otherwise("neither")
    return met.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def best_fragment(df: DataFrame, hits: Column, used: DataFrame, least: int = 400) -> DataFrame:
    """The chunk of most hits of every document that is long enough and not next to a used one (doc_id, ord)."""
    near = used.select("doc_id", F.explode(F.array(F.col("ord") - 1, F.col("ord"), F.col("ord") + 1)).alias("ord")).distinct()
    left = df.where(F.col("n_chars") >= least).withColumn("hits", hits).join(near, ["doc_id", "ord"], "left_anti")
    return left.withColumn("__rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), "ord"))).where("__rn = 1").select("doc_id", "ord", "hits")
