"""Every registered query of the engine against its DuckDB statement on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

from lithoframe.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


#: What Spark types may meet in the statements' results.
SAME = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "FLOAT": "float", "TIMESTAMP": "timestamp"}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    kinds = {d[0]: str(d[1]) for d in answer.description}
    for f in df.schema.fields:
        assert SAME.get(kinds[f.name], kinds[f.name]) == f.dataType.simpleString(), f.name
    want = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()])
    assert got == want


def test_names_are_unique_and_the_flagship_exists():
    assert catalog.FLAGSHIP in catalog.queries()
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_built_in_queries_have_no_python_in_their_plans(spark):
    for name in ("hybrid_search", "accepted_facts", "garbage_ratio", "claim_features", "applicability_decision", "hierarchy_closure", "roc_auc"):
        plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["claim_features"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
