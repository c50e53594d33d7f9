"""Registers: reconciliation, differences, upserts, first and last wins, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a partial aggregate, so a hot key costs no more than any other."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def missing_from(ids: list[DataFrame], register: DataFrame, key: str) -> DataFrame:
    """Ids that any of the tables has and the register lacks."""
    union = ids[0].select(key)
    for other in ids[1:]:
        union = union.union(other.select(key))
    return union.distinct().join(register.select(key).distinct(), key, "left_anti")


def difference(before: DataFrame, after: DataFrame, key: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(key, change, columns): rows added, removed or changed, with the changed columns in schema order."""
    values = [c for c in before.columns if c != key and c not in ignored]
    a = before.select(F.col(key), F.struct(*values).alias("_old"))
    b = after.select(F.col(key), F.struct(*values).alias("_new"))
    j = a.join(b, key, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in values]))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.size(changed) > 0, "changed")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    return j.select(key, kind.alias("change"), F.when(both, F.array_join(changed, ",")).otherwise("").alias("columns")).filter("change is not null")


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of base with the delta's values where it has some; new keys are appended."""
    new = delta.select(*[F.col(c).alias(f"_n_{c}") for c in delta.columns])
    j = base.join(new, base[key] == new[f"_n_{key}"], "full")
    value = lambda c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) if c in delta.columns else F.col(c)
    return j.select(*[value(c).alias(c) for c in base.columns])


def versioned(base: DataFrame, delta: DataFrame, key: str, version: int) -> DataFrame:
    """base (with version) after an upsert: its rows, the delta's at the new version, and which of each key is current."""
    changed = delta.select(F.col(key).alias("_k")).distinct()
    old = base.join(changed, base[key] == F.col("_k"), "left").withColumn("current", F.col("_k").isNull()).drop("_k")
    return old.unionByName(delta.withColumn("version", F.lit(version)).withColumn("current", F.lit(True)))


def hash_split(df: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """Deterministic split: the share of rows with the smallest SHA-256 of their key is discovery.

    The order is not sorted in one task: counts per 16-bit hash prefix (65536 rows at most) tell in which
    prefix the border lies, and only that prefix's rows are numbered.
    """
    h = df.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).withColumn("_p", F.left("_h", F.lit(4)))
    counts = h.groupBy("_p").count().orderBy("_p").collect()
    n = sum(r["count"] for r in counts)
    take, edge, inside = round(share * n), "", 0
    for r in counts:
        if take < r["count"]:
            edge, inside = r["_p"], take
            break
        take -= r["count"]
    else:
        edge = "g"
    w = Window.partitionBy("_p").orderBy("_h", key)
    border = h.filter(F.col("_p") == edge).withColumn("_n", F.row_number().over(w)).withColumn("split", F.when(F.col("_n") <= inside, "discovery").otherwise("validation")).drop("_n")
    rest = h.filter(F.col("_p") != edge).withColumn("split", F.when(F.col("_p") < edge, "discovery").otherwise("validation"))
    return rest.unionByName(border).drop("_h", "_p")


#: Features that a cover tells apart at most.
MOST_FEATURES = 4_096


def greedy_cover(features: DataFrame, key: str, feature: str, most: int = 10, family: str | None = None) -> list:
    """Keys picked one after another: first the richest of each family, then those with the most features still uncovered.

    Ties go to the key with more features, then to the smallest key; when nothing new is left to cover, picks
    go on in that order up to ``most``. Each key's features become one bitmap, so a round is an aggregate
    without a shuffle of rows; only one key a round reaches the driver.
    """
    names = [r[0] for r in features.select(feature).filter(F.col(feature).isNotNull()).distinct().orderBy(feature).limit(MOST_FEATURES + 1).collect()]
    if len(names) > MOST_FEATURES:
        raise ValueError("too many different features")
    words = -(-len(names) // 32) or 1
    number = F.broadcast(features.sparkSession.createDataFrame([(n, i // 32, 1 << i % 32) for i, n in enumerate(names)], features.select(feature).schema.add("_w", LongType()).add("_bit", LongType())))
    bit = lambda w: F.bit_or(F.when(F.col("_w") == w, F.col("_bit")).otherwise(0))
    cut = features.sparkSession.conf.get("spark.checkpoint.dir", None) or features.sparkSession.sparkContext.getCheckpointDir()
    maps = features.join(number, feature).groupBy(key, *([family] if family else [])).agg(*[bit(w).alias(f"_b{w}") for w in range(words)])
    maps = maps.checkpoint() if cut else maps.cache()
    total = sum((F.bit_count(f"_b{w}") for w in range(words)), F.lit(0))
    covered, picks = [0] * words, []

    def take(rows: DataFrame) -> bool:
        new = sum((F.bit_count(F.col(f"_b{w}").bitwiseAND(F.lit(~covered[w]))) for w in range(words)), F.lit(0))
        best = rows.filter(~F.col(key).isin(picks) if picks else F.lit(True)).select(key, new.alias("n"), total.alias("t"), *[f"_b{w}" for w in range(words)]).orderBy(F.desc("n"), F.desc("t"), key).limit(1).collect()
        for r in best:
            picks.append(r[key])
            for w in range(words):
                covered[w] |= r[f"_b{w}"]
        return bool(best)

    if family:
        for r in maps.select(family).distinct().orderBy(family).limit(most).collect():
            take(maps.filter(F.col(family).eqNullSafe(F.lit(r[0]))))
    while len(picks) < most and take(maps):
        pass
    return picks
