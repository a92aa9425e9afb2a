"""Claims and the sources that hold their numbers."""

import random

from pyspark.sql import functions as F

from lithoframe.operators import evidence as E
from tests.made import most_rows


def test_citations_equal_all_pairs(spark):
    r = random.Random(3)
    some = lambda: sorted({r.choice(["555", "555", f"{r.randrange(12)}0", f"{r.randrange(300)}1"]) for _ in range(r.randrange(5))})
    claims, sources = [(k, some()) for k in range(300)], [(k, some()) for k in range(1000, 1200)] + [(1000, ["9991"]), (3000, None), (1001, ["555"])]
    held = {}
    for k, x in sources:
        held.setdefault(k, set()).update(x or [])
    want = {}
    for k, x in claims:
        found = [s for s, y in held.items() if x and set(x) <= y]
        if len(found) == 1:
            want[k] = found[0]
    got = E.cite_by_numbers(spark.createDataFrame(claims, "id long, numbers array<string>"), spark.createDataFrame(sources, "source long, numbers array<string>"))
    assert {x.id: x.source for x in got.collect()} == want and len(want) > 10 and got.count() == len(want)


def test_a_common_number_makes_no_pairs(spark):
    """2,000 claims and 2,000 sources hold 555: 4,000,000 pairs, of which each claim needs one."""
    own = F.concat(F.lit("7"), F.lpad(F.col("id").cast("string"), 5, "0"))
    rows = spark.range(2000).select("id", F.array(F.lit("555"), own).alias("numbers"))
    df = E.cite_by_numbers(rows.unionByName(spark.createDataFrame([(5000, ["555"])], "id long, numbers array<string>")), rows.withColumnRenamed("id", "source"))
    assert most_rows(df) <= 10_000
    assert df.where("id = source").count() == df.count() == 2000
