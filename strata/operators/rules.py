"""Rules: relation confidence, scorecards, gates, sequence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import relation


#: Least score of each band of confidence (fixed values).
BANDS = (("high_confidence", 0.95), ("medium_confidence", 0.75), ("weak_signal", 0.45))


def confidence(pairs: DataFrame, rule: str, source: str, target: str) -> DataFrame:
    """Per rule: how many pairs agree in which way, (exact + 0.7 close + 0.4 both) / compared, and its band.

    Pairs that lack a value are not compared; a rule without compared pairs scores 0.
    """
    r = pairs.withColumn("_r", relation(F.col(source), F.col(target)))
    n = lambda k: F.count_if(F.col("_r") == k)
    compared = F.count_if(F.col("_r") != "missing_signal")
    score = F.coalesce(F.bround((n("exact") + n("close") * 0.7 + n("both_present") * 0.4) / F.nullif(compared, F.lit(0)), 4), F.lit(0.0))
    out = r.groupBy(rule).agg(n("exact").alias("exact"), n("close").alias("close"), n("both_present").alias("both_present"), compared.alias("compared"), score.alias("confidence"))
    band = F.lit("exploratory")
    for name, least in reversed(BANDS):
        band = F.when(F.col("confidence") >= least, name).otherwise(band)
    return out.withColumn("band", band)


def gate(facts: DataFrame, group: str, need: dict[str, int]) -> DataFrame:
    """Per group: the sums of the needed facts, the first one below its need, and the gate's state."""
    sums = facts.groupBy(group).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in need])
    short = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) < n, F.lit(c)) for c, n in need.items()]))
    return sums.select(group, *need, F.array_join(short, ",").alias("blockers"), F.when(F.size(short) == 0, "ready").when(F.size(short) == len(need), "empty").otherwise("blocked").alias("gate"))


def sequence_gaps(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Per key: rows, whether places rise by one from the first, and the largest step."""
    w = Window.partitionBy(key).orderBy(order)
    step = rows.withColumn("_s", F.col(order) - F.lag(order).over(w))
    return step.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.coalesce(F.max("_s"), F.lit(0)).alias("largest_step"), F.coalesce(F.bool_and(F.col("_s") == 1), F.lit(True)).alias("gapless"))


def out_of_turn(rows: DataFrame, key: str, order: str, done: str) -> DataFrame:
    """Rows that are done although an earlier row of their key is not."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.max(F.when(~F.col(done), 1).otherwise(0)).over(w)
    return rows.withColumn("_open", open_before).filter(F.col(done) & (F.col("_open") == 1)).drop("_open")


def findings(facts: DataFrame, key: str, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, severity, rule) of every check whose condition holds; a null condition does not."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, c in checks]))
    return facts.select(key, F.explode(found).alias("_f")).select(key, "_f.severity", "_f.rule")


def first_failure(facts: DataFrame, key: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """(key, failed, passed): the first check in order that does not hold, and how many did before it."""
    failed, passed = F.lit(None).cast("string"), F.lit(len(checks))
    for i, (name, ok) in reversed(list(enumerate(checks))):
        bad = ~F.coalesce(ok, F.lit(False))
        failed, passed = F.when(bad, name).otherwise(failed), F.when(bad, i).otherwise(passed)
    return facts.select(key, failed.alias("failed"), passed.alias("passed"))


def scorecard(facts: DataFrame, key: str, parts: dict[str, tuple[Column, int]], deductions: list[Column], blocked: Column) -> DataFrame:
    """(key, parts, total, level): capped parts, less deductions of 60 at most; a blocker holds the total at 59."""
    capped = [F.least(c, F.lit(most)).cast("long").alias(n) for n, (c, most) in parts.items()]
    total = sum((F.col(n) for n in parts), F.lit(0))
    df = facts.select(key, *capped, F.least(F.lit(60), sum(deductions, F.lit(0))).cast("long").alias("deducted"), F.coalesce(blocked, F.lit(False)).alias("blocked"))
    raw = F.greatest(F.lit(0), F.least(F.lit(100), total - F.col("deducted")))
    df = df.withColumn("total", F.when(F.col("blocked"), F.least(F.lit(59), raw)).otherwise(raw).cast("long"))
    return df.withColumn("level", F.least(F.lit(5), F.floor(F.col("total") / 20)).cast("int"))


def signals(pairs: DataFrame, declared: list[tuple[str, str, str, str]]) -> DataFrame:
    """(rule, priority, a, b): a row per pair and declared rule (name, source column, target column, priority)."""
    found = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(p).alias("priority"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")) for n, a, b, p in declared])
    return pairs.select(F.explode(found).alias("_s")).select("_s.*")
