"""Ordered rows of hot keys and nested records, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import linking, nested, ordering

@pytest.fixture(scope="module")
def hot(spark):
    """A key with most rows, a null key, orders with negatives, null and values beyond 2^53 that share a double."""
    rng = random.Random(2)
    order = [None, 2**60, 2**60 + 1, 2**60 + 2, *rng.sample(range(-3000, 9000), 4000)]
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), o, i, "clash") for i, o in enumerate(order)]
    return rows, spark.createDataFrame(rng.sample(rows, len(rows)), "key string, at long, id long, number string").repartition(7)


def places(rows):
    out, n = {}, {}
    for key, at, i, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        out[i] = n[key] = n.get(key, 0) + 1
    return out


@pytest.mark.parametrize("units", [1, 2, 64])
def test_numbers(hot, units):
    rows, df = hot
    assert {r["id"]: r["number"] for r in ordering.numbers(df, "key", "at", units=units).collect()} == places(rows)


def test_numbers_spread_a_key_and_take_no_rows(spark, hot):
    rows, df = hot
    ones = spark.createDataFrame([("k", 5, i) for i in range(50)], "key string, at long, id long")
    assert sorted(r["number"] for r in ordering.numbers(ones, "key", "at").collect()) == list(range(1, 51))  # ties
    assert ordering.numbers(ones.limit(0), "key", "at").count() == 0
    nothing = ones.withColumn("at", F.lit(None).cast("long"))
    assert sorted(r["number"] for r in ordering.numbers(nothing, "key", "at").collect()) == list(range(1, 51))
    borders = sorted(set(df.approxQuantile("at", [i / 8 for i in range(1, 8)], 0.5 / 8)))
    largest = df.groupBy(ordering._unit(F.col("at").cast("double"), borders)).count().agg(F.max("count")).collect()[0][0]
    assert largest < len(rows) / 8 * 2.5


def test_slots_and_gaps(spark, hot):
    rows, df = hot
    want = places(rows)
    assert {r["id"]: r["slot"] for r in ordering.round_robin(df, "key", "at", 7).collect()} == {i: (n - 1) % 7 for i, n in want.items()}
    known = spark.createDataFrame([(i,) for i in range(0, len(rows), 3)] * 2, "id long")
    got = {r["id"]: r["seq"] for r in linking.numbered(df, known, "id", "key", "at").collect()}
    assert got == {i: n for i, n in want.items() if i % 3}


def test_few_rows_of_a_key_leave_a_task(hot):
    rows, df = hot
    for out in (ordering.within_margin(df, "key", "at", "id", 3, 1e6), ordering.padded(df, "key", "at", "number", 4, "none")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Partial" in plan[plan.index("WindowGroupLimit") :], plan
    best = {}
    for key, at, i, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[2])):
        if len(best.setdefault(key, [])) < 3 and (not best[key] or at >= best[key][0][0] - 100):
            best[key].append((at, i))
    got = {}
    for r in ordering.within_margin(df, "key", "at", "id", 3, 100).collect():
        got.setdefault(r["key"], []).append((r["at"], r["id"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in best.items()}


def test_digest_does_not_depend_on_field_order(spark):
    one = "struct<b:int,a:array<struct<y:string,x:struct<q:int,p:int>>>>"
    two = "struct<a:array<struct<x:struct<p:int,q:int>,y:string>>,b:int>"
    x = spark.createDataFrame([(1, (7, [("s", (2, 1)), (None, None)])), (2, None), (3, (None, None)), (4, (7, []))], f"id int, v {one}")
    y = spark.createDataFrame([(1, ([((1, 2), "s"), (None, None)], 7)), (2, None), (3, (None, None)), (4, ([], 7))], f"id int, v {two}")
    a, b = ({r["id"]: r["d"] for r in df.select("id", nested.record_digest(df, "v").alias("d")).collect()} for df in (x, y))
    assert a == b and a[2] is None and len(set(a.values())) == 4
