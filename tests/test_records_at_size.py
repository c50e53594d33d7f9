"""Steps whose cost grew too fast: style records decoded in one task, record streams scanned a row at a time."""

import random

import pytest

from oracle import SF
from strata.operators import grids, sinks, trees
from strata.plans import layouts


@pytest.mark.parametrize("name", ["style_shapes", "border_fills"])
def test_style_records_are_made_by_all_cores(spark, monkeypatch, name):
    seen = []
    kept = sinks.kept
    monkeypatch.setattr(sinks, "kept", lambda df, label: seen.append(df.rdd.getNumPartitions()) or kept(df, label))
    getattr(layouts, name)(spark, SF)
    assert seen == [spark.sparkContext.defaultParallelism]


def test_table_fields_read_each_number_once(spark):
    df = spark.createDataFrame([(b"\0" * 22,)], "body binary")
    assert grids.table_fields(df)._jdf.queryExecution().analyzed().toString().count("conv(") <= 6


@pytest.mark.parametrize("levels", [6, 500])
def test_parents_across_batches_agree_with_a_search(spark, levels):
    r = random.Random(levels)
    rows = [(k, i, r.choice([None, *range(levels)])) for k in (None, 1, 2, 3) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, i long, lv int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        got = {(x["k"], x["i"]): (x["parent1"], x["parent2"], x["depth"]) for x in trees.parents(df, "k", "i", "lv", up=2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    level = {(k, i): lv for k, i, lv in rows}

    def up(k, i):
        return next((j for j in range(i - 1, -1, -1) if level[k, j] is not None and level[k, j] < level[k, i]), None)

    for k, i, lv in rows:
        if lv is None:
            assert got[k, i] == (None, None, None)
            continue
        chain = [i]
        while chain[-1] is not None:
            chain.append(up(k, chain[-1]))
        assert got[k, i] == (*(chain + [None])[1:3], len(chain) - 2)
