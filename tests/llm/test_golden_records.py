"""Golden records against a plain loop over whole clusters."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lithoframe.llm import golden_records as G

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
START = dt.datetime(2024, 1, 1)


def brute(rows):
    clusters = defaultdict(list)
    for row in rows:
        r = dict(zip(COLUMNS, row))
        for c in ("name", "email", "city", "segment"):
            if r[c] is not None and not r[c].strip(" \t\n\v\f\r"):
                r[c] = None
        if r["balance"] is not None and not math.isfinite(r["balance"]):
            r["balance"] = None
        r["trust"] = G.TRUST.index(r["source"]) if r["source"] in G.TRUST else len(G.TRUST)
        clusters[r["client_id"] if r["master_id"] is None else r["master_id"]].append(r)
    last = lambda x: (x is None, 0 if x is None else x)
    out = {}
    for cluster, own in clusters.items():
        latest = max((r["updated_at"] for r in own if r["updated_at"]), default=None)
        for r in own:
            r["stale"] = r["updated_at"] is None or r["updated_at"] < latest - dt.timedelta(hours=1440)
        recent = lambda r: (last(r["updated_at"] and (START - r["updated_at"]) / dt.timedelta(microseconds=1)), r["trust"], last(r["client_id"]))
        trusted = lambda r: (r["stale"], r["trust"], recent(r))

        def best(field, key):
            return min((r for r in own if r[field] is not None), key=key, default=None)

        segment, email = best("segment", recent), best("email", trusted)
        name = best("name", lambda r: (-len(r["name"]), trusted(r)))
        balance = best("balance", lambda r: (not (segment and r["segment"] == segment["segment"]), recent(r)))
        address = min(own, key=lambda r: (-(r["city"] is not None) - (r["nation_id"] is not None), trusted(r)))
        take = lambda r, c: r and r[c]
        out[cluster] = (
            len(own), sum(r["stale"] for r in own), take(name, "name"), take(email, "email"), take(segment, "segment"), address["city"], address["nation_id"],
            None if balance is None else math.floor(100 * balance["balance"] + 0.5), take(name, "client_id"), take(email, "client_id"), take(segment, "client_id"), take(balance, "client_id"),
            None if address["city"] is None and address["nation_id"] is None else address["client_id"],
        )
    return out


def clients(n, seed, hot=0.4, step=dt.timedelta(hours=7)):
    r = random.Random(seed)
    some = lambda *x: r.choice([None, "", " \t", *x])
    return [
        (k, None if r.random() < 0.3 else 3 if r.random() < hot else r.randrange(n // 4), r.choice([*G.TRUST, "fax", None]), None if r.random() < 0.1 else START + step * r.randrange(500),
         some("Ann", "Ann Lee", "Änn Lëe", " Bo "), some("a@x", "b@x"), some("Rome", "Oslo"), r.choice([None, 1, 2]), some("retail", "public", "export"), r.choice([None, float("nan"), 0.005, 1.255, -3.5, r.random() * 100]))
        for k in range(n)
    ]


def run(df):
    out = {}
    for r in G.golden_records(df).collect():
        assert r[0] not in out
        out[r[0]] = tuple(r)[1:]
    return out


@pytest.mark.parametrize("parts, block, fan", [(3, 100_000, 16), (12, 40, 2)])
def test_records_equal_a_plain_loop(spark, monkeypatch, parts, block, fan):
    monkeypatch.setattr(G, "BLOCK", block)
    monkeypatch.setattr(G, "FAN", fan)
    monkeypatch.setattr(G, "DENSE", 4)
    rows = clients(600, 1)
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(parts)) == brute(rows)


def test_stale_to_the_microsecond(spark):
    limit = dt.timedelta(hours=1440)
    tick = dt.timedelta(microseconds=1)
    rows = [(k, 1, "crm", at, f"n{k}", None, None, None, None, None) for k, at in enumerate([START + limit, START, START - tick, START + tick, START - dt.timedelta(hours=1), None, START + dt.timedelta(minutes=3)])]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)
    assert brute(rows)[1][1] == 3


def test_survivors_of_a_large_cluster_stay_few(spark):
    rows = clients(3000, 2, hot=1.0)
    pruned = G.prune_partitions(G.records(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    kept = pruned.where("kind = 0 AND cluster = 3").count()
    assert kept <= 5 * (3 + 3 * (len(G.TRUST) + 1))
    assert pruned.where("kind = 2").selectExpr("sum(n)").first()[0] == len(rows)


def test_many_segments_and_times_in_one_cluster(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 64)
    r = random.Random(4)
    rows = [(k, 7, r.choice(G.TRUST), START + dt.timedelta(microseconds=r.randrange(10**13)), f"n{k}", None, None, None, f"s{r.randrange(300)}", float(k) if k % 3 else None) for k in range(900)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(6)) == brute(rows)


def test_edges(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == {}
    nulls = [(None,) * 10] * 3
    assert run(spark.createDataFrame(nulls, SCHEMA)) == brute(nulls)
    rows = clients(30, 5) * 3 + [(None, None, "crm", START, "No One", None, "Rome", None, None, 2.0)] * 40
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS cluster", "'clash' AS trust", "'clash' AS at", "'clash' AS kind", "'clash' AS n")
    assert run(clash) == brute(rows)
    long = [(1, None, "web", START, "x" * 300_000, None, None, None, None, 1e300)]
    assert run(spark.createDataFrame(long, SCHEMA))[1][:3] == (1, 0, "x" * 300_000)
    zoned = spark.createDataFrame(clients(50, 6), SCHEMA).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    assert run(zoned) == brute(clients(50, 6))
