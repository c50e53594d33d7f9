"""Containment joins: which ranges a point lies in, by equi-joins on dyadic pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places are below 2^LEVELS.
LEVELS = 31


def within(points: DataFrame, ranges: DataFrame, key: str, at: str, first: str, last: str) -> DataFrame:
    """Each point with each range of its key that holds it (first <= at <= last), columns of both, the range's key left out.

    A range is cut into the largest pieces whose length is a power of two and whose begin is a multiple of it,
    two of each length at most; a point lies in one piece of each length. A pair meets in exactly one
    piece, so that there is neither a comparison of all pairs of a key nor a pair found twice. A point emits as
    many rows as there are lengths in use. Places are integers from 0 and below 2^31; nulls and ranges that
    end before they begin hold nothing.
    """
    # at each length, the pieces from number a to before b lie in the range: the left one stands alone if a is odd, the right one if b is
    a, b = f"shiftright(cast(`{first}` as bigint) + shiftleft(1L, k) - 1, k)", f"shiftright(cast(`{last}` as bigint) + 1, k)"
    alone = lambda end, node: f"named_struct('k', k, 'node', if({a} < {b} and {end} % 2 = 1, {node}, null))"
    pieces = F.expr(f"filter(flatten(transform(sequence(0, {LEVELS - 1}), k -> array({alone(a, a)}, {alone(b, f'{b} - 1')}))), p -> p.node is not null)")
    r = ranges.filter(F.col(last) >= F.col(first)).withColumn("_p", F.explode(pieces))
    r = r.select(F.col(key).alias("_key"), *[c for c in ranges.columns if c != key], F.col("_p.k").alias("_k"), F.col("_p.node").alias("_node"))
    top = F.broadcast(r.agg(F.array_sort(F.collect_set("_k")).alias("_levels")))  # lengths in use: 31 at most
    p = points.join(top).withColumn("_k", F.explode("_levels")).withColumn("_node", F.expr(f"shiftright(cast(`{at}` as bigint), _k)")).drop("_levels")
    return p.join(r, (p[key] == r["_key"]) & (p["_k"] == r["_k"]) & (p["_node"] == r["_node"])).drop("_key", "_k", "_node")


def nearest(points: DataFrame, ranges: DataFrame, key: str, at: str, first: str, last: str, kinds: dict) -> DataFrame:
    """Points with the begin of the innermost range that holds them, for each named condition on ranges; null where there is none.

    Ranges nest, as elements do: of those that hold a point, the innermost begins last. Points are told apart
    by key and place.
    """
    held = within(points.select(key, at), ranges, key, at, first, last)
    found = held.groupBy(key, at).agg(*[F.max(F.when(cond, F.col(first))).alias(name) for name, cond in kinds.items()])
    return points.join(found, [key, at], "left")
