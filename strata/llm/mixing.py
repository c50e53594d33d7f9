"""Mixing sources to target weights with DataFrame operations alone.

Token counts are summed per source, each source's repetition rate follows from its target, and every
document is emitted floor(rate) times plus one more time when a hash-seeded Bernoulli draw falls below
the fraction. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, written

_DRAW = float(2**52)


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null and for texts of white space only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Targets per source from (source, source_size).

    Sources in code-point order, null last, take the weights in turn and share ``share`` (a fraction)
    of all sizes. A target stops at ``most`` times the source's size and the excess goes to the others
    by weight, until none is above: that fixed point is min(cap, level * weight), and the level is the
    one at the first source, in order of cap / weight, that the level does not fill. The tables here
    have one row per source, however many documents there are. An empty source has target 0.
    """
    everything = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * most).withColumn("_fill", F.col("_cap") / F.col("_w"))
    by_fill = Window.orderBy("_fill", F.col("source").isNull(), F.col("source"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    budget = F.sum("source_size").over(whole) * F.lit(float(share[0])) / F.lit(float(share[1]))
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(rest)
    ranked = ranked.withColumn("_level", level)
    found = F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_level"))).over(whole)["_level"]
    target = F.when(F.col("_fill") < found, F.col("_cap").cast("double")).otherwise(F.least(found * F.col("_w"), F.col("_cap").cast("double")))
    return ranked.select("source", "source_size", F.coalesce(target, F.col("_cap").cast("double")).alias("target"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(seed)).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(_DRAW)


def _planned(docs: DataFrame, seed: str, key: str, **how) -> DataFrame:
    """docs with _mx_size, _mx_all, _mx_target and _mx_copies."""
    sized = docs.withColumn("_mx_size", word_count(F.col("text")))
    sums = sized.groupBy("source").agg(F.sum("_mx_size").alias("source_size"))
    # a row per source; broadcast behind a check of their number, so that texts need not be dealt by a few hot sources
    targets = small(written(source_targets(sums, **how).toDF("_mx_source", "_mx_all", "_mx_target"), "targets"))
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["_mx_source"]), "left").drop("_mx_source")
    rate = F.when(F.col("_mx_all") > 0, F.col("_mx_target") / F.col("_mx_all")).otherwise(F.lit(0.0))
    more = F.when(draw(F.col(key), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("_mx_copies", (F.floor(rate) + more).cast("int"))


def mix_plan(docs: DataFrame, seed: str = "mix", key: str = "doc_id", **how) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes each row).

    Null or blank texts have size 0 and are taken like any other row. Rows that repeat a key draw
    alike. Columns of docs named like those added are replaced. An empty table gives an empty one.
    """
    names = {"size": "_mx_size", "source_size": "_mx_all", "target": "_mx_target", "copies": "_mx_copies"}
    kept = [c for c in docs.columns if c not in names]
    return _planned(docs, seed, key, **how).select(*kept, *[F.col(v).alias(k) for k, v in names.items()])


def mix(docs: DataFrame, seed: str = "mix", key: str = "doc_id", **how) -> DataFrame:
    """The mix itself: every row of docs repeated as often as its source's rate says, with docs' columns."""
    taken = _planned(docs, seed, key, **how).filter("_mx_copies > 0")
    return taken.withColumn("_mx_copy", F.explode(F.expr("sequence(1, _mx_copies)"))).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return mix_plan(docs.select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
f AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS fill FROM r),
l AS (SELECT *, (sum(source_size) OVER () * 3.0::DOUBLE / 2.0::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
g AS (SELECT min({'a': fill, 'b': level}).b AS found FROM l WHERE level <= fill),
t AS (SELECT source, source_size, CASE WHEN found IS NULL OR fill < found THEN cap::DOUBLE ELSE least(found * w, cap::DOUBLE) END AS target FROM l, g),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || 'mix'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM c
"""
