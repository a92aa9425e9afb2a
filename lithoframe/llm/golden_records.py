"""Golden record survivorship: map-side dominance pruning, then grouped pandas.

A cluster's golden record takes each field from one of its records.  Each input
partition first keeps only records that can still win something (`prune`): for its
part of a cluster the latest record, the best segment, for each level of trust the
best email, name and address, the best balance, and for each segment the best
balance.  Staleness needs no look at other partitions: of records with equal trust
the latest is fresh if any is, so one winner for each trust decides for fresh and
stale alike.  Beside these go counts by time, from which the stale records are
counted once the cluster's latest time is known.

No task receives a cluster whole.  Survivors of clusters that are dense in a
partition are pruned again in rounds of `FAN` partitions each, until one round
covers all partitions; what is left is dealt by cluster, sorted, and finished in
pandas, block by block with only whole clusters in hand, and a cluster longer than
a block is pruned as it streams by.  Balances by segment are aggregated by cluster
and segment, and joined to the chosen segments.  Stale records: an hour before the
limit's counts whole, the hour of the limit by its times, joined by cluster and hour.

Edge cases: records without master_id and client_id form one cluster of null id;
sources that are unknown or null are the least trusted; empty and white strings are
null, others stay as they are, however long; balances that are not finite are null;
a record without a time is stale and last in recency; records that are equal in
time, trust and client_id are put in order by their other fields, so repeated rows
change the counts only; an empty table gives no record; other columns are not read.
Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm.common import WHITE, materialize, table

#: Sources by falling trust.
TRUST = ("crm", "web", "store", "partner")
#: A record is stale from this many hours before its cluster's latest.
STALE_HOURS = 60 * 24
#: Rows in hand at a time, partitions that one round of pruning joins, and rows of a cluster in one block that make it dense.
BLOCK, FAN, DENSE = 100_000, 16, 32

_HOUR = 3_600_000_000
_STRINGS = ("name", "email", "segment", "city")
_RECORD = ["cluster", "client_id", "trust", "at", "name", "email", "segment", "city", "nation_id", "balance"]
_SCHEMA = "kind tinyint, cluster long, client_id long, trust tinyint, at long, name string, email string, segment string, city string, nation_id long, balance double, n long, dense boolean, part int"
#: Kinds of rows: a record that may supply a field, a segment's best balance, a count of records of one time.
RECORD, BALANCE, COUNT = 0, 1, 2


def records(clients: DataFrame) -> DataFrame:
    """The records with their cluster, trust level and time in microseconds; empty strings and odd balances as null."""
    source = F.col("source")
    trust = F.lit(len(TRUST))
    for level, name in enumerate(TRUST):
        trust = F.when(source == name, level).otherwise(trust)
    text = lambda c: F.when(~F.col(c).rlike(f"^(?:{WHITE})?\\z"), F.col(c).cast("string")).alias(c)
    balance = F.col("balance").cast("double")
    finite = F.when(F.abs(balance) < float("inf"), balance).alias("balance")
    ids = [F.coalesce("master_id", "client_id").cast("long").alias("cluster"), F.col("client_id").cast("long").alias("client_id")]
    return clients.select(*ids, trust.cast("tinyint").alias("trust"), F.col("updated_at").alias("at"), *[text(c) for c in _STRINGS], F.col("nation_id").cast("long").alias("nation_id"), finite)


def by_recency(df: pd.DataFrame) -> pd.DataFrame:
    """Sorted by cluster and, within it, latest first, then trust, client_id and the other fields; nulls last."""
    keys = ["cluster", "_at", "trust", "client_id"]
    out = df.assign(_at=-df["at"])
    if out.duplicated(keys).any():
        keys += ["name", "email", "segment", "city", "nation_id", "balance"]
    out = out.sort_values(keys, na_position="last", kind="stable", ignore_index=True).drop(columns="_at")
    out["_chars"] = -out["name"].str.len().astype("float64")
    out["_filled"] = -(out["city"].notna().astype("int8") + out["nation_id"].notna().astype("int8"))
    return out


def first(df: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    return df[~df.duplicated(keys)]


def prune(df: pd.DataFrame, keys: tuple[str, ...] = ("cluster",)) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Records that can still win a field of their group, and the best balance of each segment.  Pruning again changes nothing."""
    names, df = list(df.columns), by_recency(df)
    key, level = list(keys), [*keys, "trust"]
    valued = df[df["balance"].notna()]
    winners = [
        first(df, key),
        first(df[df["segment"].notna()], key),
        first(df[df["email"].notna()], level),
        first(df[df["name"].notna()].sort_values("_chars", kind="stable"), level),
        first(df.sort_values("_filled", kind="stable"), level),
        first(valued, key),
    ]
    kept = df.loc[np.unique(np.concatenate([w.index for w in winners])), names]
    return kept, first(valued[valued["segment"].notna()], [*key, "segment"])[names]


def stale(df: pd.DataFrame) -> pd.Series:
    """Whether a record's time is too long before the latest of its cluster in ``df``; false without a time."""
    return (df.groupby("cluster", dropna=False)["at"].transform("max") - df["at"] > STALE_HOURS * _HOUR).fillna(False).astype(bool)


def count_times(df: pd.DataFrame) -> pd.DataFrame:
    """Records by cluster and time; those that are stale by what is in hand alone count as of no time."""
    return df.assign(at=df["at"].mask(stale(df))).groupby(["cluster", "at"], dropna=False, as_index=False, sort=False)["n"].sum()


def _frame(batch: pa.RecordBatch, names: list[str]) -> pd.DataFrame:
    kinds = {pa.int64(): pd.Int64Dtype(), pa.string(): pd.StringDtype("python")}
    columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
    columns = [c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in columns]
    return pa.Table.from_arrays(columns, names).to_pandas(types_mapper=kinds.get)


_FIELDS = [("kind", pa.int8()), ("cluster", pa.int64()), ("client_id", pa.int64()), ("trust", pa.int8()), ("at", pa.int64()), *[(c, pa.string()) for c in _STRINGS], ("nation_id", pa.int64()), ("balance", pa.float64()), ("n", pa.int64()), ("dense", pa.bool_()), ("part", pa.int32())]


def _batch(df: pd.DataFrame, fields: list, **constant) -> pa.RecordBatch:
    columns = [pa.repeat(pa.scalar(constant[c], kind), len(df)) if c in constant else pa.array(df[c], kind, from_pandas=True) if c in df else pa.nulls(len(df), kind) for c, kind in fields]
    return pa.RecordBatch.from_arrays(columns, names=[c for c, _ in fields])


def prune_partitions(rows: DataFrame) -> DataFrame:
    """Survivors and counts of each partition, in blocks of bounded size; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kept = best = counts = None
        dense: set = set()

        def take_in(hand: list[pd.DataFrame]) -> None:
            nonlocal kept, best, counts
            df = pd.concat(hand, ignore_index=True)
            sizes = df.groupby("cluster", dropna=False).size()
            dense.update(sizes.index[sizes >= DENSE])
            times = df[["cluster", "at"]].assign(n=1)
            counts = count_times(times if counts is None else pd.concat([counts, times], ignore_index=True))
            own, own_best = prune(df)
            kept = own if kept is None else prune(pd.concat([kept, own], ignore_index=True))[0]
            best = own_best if best is None else prune(pd.concat([best, own_best], ignore_index=True))[1]

        def give_out() -> Iterator[pa.RecordBatch]:
            nonlocal kept, best, counts
            crowded = kept["cluster"].isin([c for c in dense if c is not pd.NA]) | (kept["cluster"].isna() & any(c is pd.NA for c in dense))
            yield _batch(kept.assign(dense=crowded.astype(bool)), _FIELDS, kind=RECORD, part=part)
            yield _batch(best, _FIELDS, kind=BALANCE, part=part, dense=False)
            yield _batch(counts, _FIELDS, kind=COUNT, part=part, dense=False)
            kept = best = counts = None
            dense.clear()

        hand, size = [], 0
        for batch in batches:
            hand.append(_frame(batch, _RECORD))
            size += batch.num_rows
            if size >= BLOCK:
                take_in(hand)
                hand, size = [], 0
                if max(len(kept), len(best), len(counts)) >= BLOCK // 2:
                    yield from give_out()
        if size:
            take_in(hand)
        if kept is not None:
            yield from give_out()

    return materialize(rows.mapInArrow(run, _SCHEMA), "survivors")


def prune_dense(survivors: DataFrame, parts: int) -> DataFrame:
    """Survivors of dense clusters, pruned in rounds; a group of a round comes from `FAN` parts of the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            df = _frame(batch, [*_RECORD, "part"])
            kept = df if kept is None else pd.concat([kept, df], ignore_index=True)
            if len(kept) >= BLOCK:
                kept = prune(kept, ("cluster", "part"))[0]
                if len(kept) >= BLOCK // 2:
                    yield _batch(kept, _FIELDS, kind=RECORD, dense=True)
                    kept = None
        if kept is not None:
            yield _batch(prune(kept, ("cluster", "part"))[0], _FIELDS, kind=RECORD, dense=True)

    out = survivors.where("dense")
    while parts > FAN:
        parts = -(-parts // FAN)
        out = out.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).repartition("cluster", "part").mapInArrow(run, _SCHEMA)
    return out


_CHOSEN = [("cluster", pa.int64()), *[(c, pa.string()) for c in _STRINGS], ("nation_id", pa.int64()), ("balance", pa.float64()), *[(f"{c}_from", pa.int64()) for c in ("name", "email", "segment", "balance", "address")]]


def choose(df: pd.DataFrame) -> pd.DataFrame:
    """One row for each cluster of survivors; the balance is the best of any segment."""
    df = by_recency(df)
    df["_stale"] = stale(df) | df["at"].isna()
    trusted = df.sort_values(["_stale", "trust"], kind="stable")
    sources = [
        (trusted[trusted["name"].notna()].sort_values("_chars", kind="stable"), {"client_id": "name_from", "name": "name"}),
        (trusted[trusted["email"].notna()], {"client_id": "email_from", "email": "email"}),
        (df[df["segment"].notna()], {"client_id": "segment_from", "segment": "segment"}),
        (df[df["balance"].notna()], {"client_id": "balance_from", "balance": "balance"}),
        (trusted.sort_values("_filled", kind="stable"), {"client_id": "address_from", "city": "city", "nation_id": "nation_id"}),
    ]
    out = first(df, ["cluster"])[["cluster"]]
    for ordered, columns in sources:
        out = out.merge(first(ordered, ["cluster"])[["cluster", *columns]].rename(columns=columns), on="cluster", how="left")
    out["address_from"] = out["address_from"].mask(out["city"].isna() & out["nation_id"].isna())
    return out


def choose_records(survivors: DataFrame) -> DataFrame:
    """`choose` for whole clusters; ``survivors`` is dealt and sorted by cluster, and read in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand, size = [], 0
        for batch in batches:
            hand.append(_frame(batch, _RECORD))
            size += batch.num_rows
            if size >= BLOCK:
                df = pd.concat(hand, ignore_index=True)
                last = df["cluster"].iloc[-1]
                open_ = df["cluster"].isna() if last is pd.NA else df["cluster"].eq(last).fillna(False)
                if not open_.all():
                    yield _batch(choose(df[~open_]), _CHOSEN)
                hand = [prune(df[open_])[0]]
                size = len(hand[0])
        if size:
            yield _batch(choose(pd.concat(hand, ignore_index=True)), _CHOSEN)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return survivors.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, ", ".join(f"{c} {kinds[k]}" for c, k in _CHOSEN))


def count_stale(counts: DataFrame) -> DataFrame:
    """(cluster, n_records, n_stale) from records by cluster and time (null: stale)."""
    timed = counts.select("cluster", "at", "n", F.expr(f"(at - pmod(at, {_HOUR})) div {_HOUR}").alias("hour"))
    hours = timed.groupBy("cluster", "hour").agg(F.sum("n").alias("n"), F.max("at").alias("latest"))
    whole = hours.groupBy("cluster").agg(F.sum("n").alias("n_records"), (F.max("latest") - STALE_HOURS * _HOUR).alias("limit"), F.collect_list(F.struct("hour", "n")).alias("hours"))
    whole = whole.withColumn("limit_hour", F.expr(f"(limit - pmod(limit, {_HOUR})) div {_HOUR}"))
    before = F.filter("hours", lambda h: h["hour"].isNull() | (h["hour"] < F.col("limit_hour")))
    whole = whole.select("cluster", "n_records", "limit", "limit_hour", F.aggregate(before, F.lit(0).cast("long"), lambda s, h: s + h["n"]).alias("before"))
    limits = whole.select(F.col("cluster").alias("__c"), "limit", "limit_hour")
    edge = timed.join(limits, F.col("cluster").eqNullSafe(F.col("__c")) & (F.col("hour") == F.col("limit_hour"))).where(F.col("at") < F.col("limit")).groupBy("__c").agg(F.sum("n").alias("edge"))
    return whole.join(edge, F.col("cluster").eqNullSafe(F.col("__c")), "left").select("cluster", "n_records", (F.col("before") + F.coalesce("edge", F.lit(0))).alias("n_stale"))


def _in_order(*names: str) -> Column:
    """By recency, then the other fields; nulls last."""
    values = {"at": -F.col("at")}
    return F.struct(*[x.alias(f"{n}{k}") for n in names for k, x in enumerate((F.col(n).isNull(), values.get(n, F.col(n))))])


def golden_records(clients: DataFrame) -> DataFrame:
    """One record per cluster: fields, counts, and the client_id that each field is from."""
    pruned = prune_partitions(records(clients))
    survivors = pruned.where(F.col("kind") == RECORD)
    parts = (survivors.agg(F.max("part")).first()[0] or 0) + 1
    chosen = choose_records(survivors.where(~F.col("dense")).unionByName(prune_dense(survivors, parts)))
    best = F.min_by(F.struct("balance", "client_id"), _in_order("at", "trust", "client_id", "name", "email", "city", "nation_id", "balance"))
    balances = pruned.where(F.col("kind") == BALANCE).groupBy(F.col("cluster").alias("__c"), F.col("segment").alias("__s")).agg(best.alias("own"))
    counts = count_stale(pruned.where(F.col("kind") == COUNT)).withColumnRenamed("cluster", "__n")
    out = chosen.join(balances, F.col("cluster").eqNullSafe(F.col("__c")) & (F.col("segment") == F.col("__s")), "left").join(counts, F.col("cluster").eqNullSafe(F.col("__n")))
    pick = lambda field, other: F.when(F.col("own").isNotNull(), F.col("own")[field]).otherwise(F.col(other))
    return out.select(
        F.col("cluster").alias("cluster_id"),
        "n_records",
        "n_stale",
        "name",
        "email",
        "segment",
        "city",
        F.col("nation_id").cast(clients.schema["nation_id"].dataType).alias("nation_id"),
        F.floor(100 * pick("balance", "balance") + 0.5).cast("long").alias("balance_cents"),
        "name_from",
        "email_from",
        "segment_from",
        pick("client_id", "balance_from").alias("balance_from"),
        "address_from",
    )


def op13_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_records(table(spark, sf_dir, "clients"))


def _picked(name: str, columns: str, need: str, order: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT cluster_id, {columns}, row_number() OVER (PARTITION BY cluster_id ORDER BY {order}) AS rn FROM rec WHERE {need}) WHERE rn = 1)"


_RECENT = "updated_at DESC NULLS LAST, trust, client_id"
_TRUSTED = f"stale, trust, {_RECENT}"
_TEXTS = ", ".join(rf"CASE WHEN regexp_full_match({c}, '[\x20\x09-\x0D]*') THEN NULL ELSE {c} END AS {c}" for c in _STRINGS)
OP13_SQL = f"""
WITH base AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, CASE source WHEN 'crm' THEN 0 WHEN 'web' THEN 1 WHEN 'store' THEN 2 WHEN 'partner' THEN 3 ELSE 4 END AS trust,
  {_TEXTS}, nation_id, balance FROM clients),
rec AS (SELECT *, updated_at IS NULL OR updated_at < max(updated_at) OVER (PARTITION BY cluster_id) - INTERVAL 1440 HOUR AS stale FROM base),
counts AS (SELECT cluster_id, count(*) AS n_records, count(*) FILTER (stale) AS n_stale FROM rec GROUP BY cluster_id),
{_picked("seg", "segment, client_id AS segment_from", "segment IS NOT NULL", _RECENT)},
{_picked("nam", "name, client_id AS name_from", "name IS NOT NULL", "length(name) DESC, " + _TRUSTED)},
{_picked("ema", "email, client_id AS email_from", "email IS NOT NULL", _TRUSTED)},
{_picked("adr", "city, nation_id, CASE WHEN city IS NULL AND nation_id IS NULL THEN NULL ELSE client_id END AS address_from", "TRUE", "(city IS NOT NULL)::INTEGER + (nation_id IS NOT NULL)::INTEGER DESC, " + _TRUSTED)},
bal AS (SELECT * FROM (SELECT rec.cluster_id, balance, client_id AS balance_from, row_number() OVER (PARTITION BY rec.cluster_id ORDER BY coalesce(rec.segment = seg.segment, FALSE) DESC, {_RECENT}) AS rn
  FROM rec LEFT JOIN seg ON seg.cluster_id IS NOT DISTINCT FROM rec.cluster_id WHERE balance IS NOT NULL) WHERE rn = 1)
SELECT c.cluster_id, n_records, n_stale, name, email, segment, city, nation_id, CAST(floor(100 * balance + 0.5) AS BIGINT) AS balance_cents, name_from, email_from, segment_from, balance_from, address_from
FROM counts c {" ".join(f"LEFT JOIN {t} ON {t}.cluster_id IS NOT DISTINCT FROM c.cluster_id" for t in ("seg", "nam", "ema", "adr", "bal"))}
"""
