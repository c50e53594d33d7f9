"""Operators on ordered rows of a key: margins, filling, scopes, slices, slots, parents, padding.

Most are one window per key: rows of a key are sorted in one task, as their order demands. Those that need
less do with less: ``numbers`` and ``round_robin`` split a key by ranges of its order, ``within_margin`` and
``padded`` keep a few rows of a key in each task before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _unit(order: Column, borders: list[float], first: int = 0) -> Column:
    """How many of the ascending borders are at or below a value: a binary search as nested conditions."""
    if not borders:
        return F.lit(first)
    m = len(borders) // 2
    return F.when(order < borders[m], _unit(order, borders[:m], first)).otherwise(_unit(order, borders[m + 1 :], first + m + 1))


def numbers(df: DataFrame, key: str, order: str, name: str = "number", units: int = 64) -> DataFrame:
    """Rows of each key numbered from 1 by a numeric ``order`` (nulls first; ties in any order), a key spread over tasks.

    The order's range is cut at ``units`` - 1 quantiles of the whole table, known to half a unit. A row's
    number is its place among the key's rows of its unit, after the counts of the units before it, of which
    there are ``units`` a key at most. A null key is a key of its own; an empty table gives an empty one. A
    column named like ``name`` is replaced.
    """
    df = df.drop(name)
    borders = sorted(set(df.approxQuantile(order, [i / units for i in range(1, units)], 0.5 / units))) if units > 1 else []
    unit = F.when(F.col(order).isNull(), 0).otherwise(_unit(F.col(order).cast("double"), borders))
    dealt = df.withColumn("_k", F.struct(key)).withColumn("_u", unit)  # structs of nulls are equal, so that null keys join
    before = Window.partitionBy("_k").orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_k", "_u").agg(F.count("*").alias("_n"))
    starts = counts.select("_k", "_u", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_k", "_u").orderBy(order))
    return dealt.join(starts, ["_k", "_u"]).withColumn(name, F.col("_start") + within).drop("_k", "_u", "_start")


def within_margin(df: DataFrame, key: str, score: str, tie: str, most: int, margin: float) -> DataFrame:
    """The ``most`` best rows of each key that lie within ``margin`` of its best; ties to the smallest ``tie``.

    The bound on row numbers reaches below the shuffle: a task sends ``most`` rows of a key at most.
    """
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    top = df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return top.withColumn("_top", F.first(score).over(w)).filter(F.col(score) >= F.col("_top") - margin).drop("_top")


def forward_fill(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A null inherits the last value before it; nulls before the first value stay."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def scopes(df: DataFrame, key: str, order: str, marker: Column, name: str = "scope") -> DataFrame:
    """Number of the marker whose scope a row lies in; 0 before the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(marker, 1).otherwise(0)).over(w))


def spans(df: DataFrame, key: str, start: str, length: str) -> DataFrame:
    """A row's end: the next row's start, for the last one the length of the whole."""
    w = Window.partitionBy(key).orderBy(start)
    return df.withColumn("end", F.least(F.coalesce(F.lead(start).over(w), F.col(length)), F.col(length)))


def positions(df: DataFrame, key: str, order: str, width: Column) -> DataFrame:
    """Where each row begins once all before it have been laid out with their widths."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("begins", F.coalesce(F.sum(width).over(w), F.lit(0)).cast("long"))


def round_robin(df: DataFrame, key: str, order: str, slots: int) -> DataFrame:
    """Slots dealt in turn: their counts differ by one at most, and the first ones take what is left over."""
    dealt = numbers(df, key, order, "slot")
    return dealt.withColumn("slot", F.pmod(F.col("slot") - 1, F.lit(slots)).cast("int"))


def rescale(df: DataFrame, key: str, value: str, target: float) -> DataFrame:
    """Values brought down in proportion where a key's greatest is above the target; halves go to even."""
    top = df.groupBy(F.col(key).alias("_k")).agg(F.max(value).cast("double").alias("_top"))
    j = df.join(top, df[key].eqNullSafe(F.col("_k")))
    scaled = F.bround(F.col(value) * target / F.col("_top"))
    return j.withColumn("scaled", F.when(F.col("_top") > target, scaled).otherwise(F.col(value).cast("double"))).drop("_k", "_top")


def parents(df: DataFrame, key: str, order: str, level: str, levels: int) -> DataFrame:
    """The order value of the last earlier row with a smaller level, null where there is none.

    One running value for each of the ``levels`` levels replaces a self-join.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == i, F.col(order))).over(w) for i in range(1, levels + 1)]
    df = df.select("*", *[c.alias(f"_l{i}") for i, c in enumerate(last, 1)])
    cases = [F.when(F.col(level) > i, F.col(f"_l{i}")) for i in range(1, levels + 1)]
    return df.withColumn("parent", F.greatest(*cases)).drop(*[f"_l{i}" for i in range(1, levels + 1)])


def padded(df: DataFrame, key: str, order: str, value: str, n: int, fill: str) -> DataFrame:
    """(key, items): the first ``n`` values of each key in order, filled up to ``n``."""
    few = df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order, value))).filter(F.col("_place") <= n)
    items = F.transform(F.array_sort(F.collect_list(F.struct("_place", value))), lambda s: s[value])
    cut = few.groupBy(key).agg(items.alias("items"))
    return cut.withColumn("items", F.concat("items", F.array_repeat(F.lit(fill), F.lit(n) - F.size("items"))))


def prefer(df: DataFrame, key: str, candidates: list[tuple[str, Column]]) -> DataFrame:
    """(key, origin, value): the first candidate that is neither null nor blank, with its name."""
    ok = [(n, c, c.isNotNull() & (F.trim(c) != "")) for n, c in candidates]
    pick = lambda i: reduce(lambda acc, x: acc.when(x[2], (F.lit(x[0]), x[1])[i]), ok[1:], F.when(ok[0][2], (F.lit(ok[0][0]), ok[0][1])[i]))
    return df.select(key, pick(0).alias("origin"), pick(1).alias("value"))
