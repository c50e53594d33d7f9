"""Connected components by contraction, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id of an edge; component is the smallest id that can be reached.

    Each round hooks every vertex to its smallest neighbour, jumps once along the hooks, and contracts
    the edges; a star or a short chain takes one round, a long chain a number that grows with the
    logarithm of its length. Each round's table is written in the shared folder, so that lineage stays
    short and lost executors cost one round at most. Loops and repeated edges do no harm.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = pairs.union(pairs.select("v", "u")).distinct()
    now = written(both, "cc-edges")
    labels = written(now.select(F.col("u").alias("id")).distinct().withColumn("component", F.col("id")), "cc-labels")
    while now.limit(1).count():
        hook = now.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        hook = written(hook, "cc-hook")
        jump = hook.join(hook.select(F.col("u").alias("p"), F.col("p").alias("q")), "p", "left").select("u", F.coalesce("q", "p").alias("q"))
        jump = written(jump, "cc-jump")
        to = lambda c: jump.select(F.col("u").alias(c), F.col("q").alias(c + "_to"))
        moved = now.filter("u < v").join(to("u"), "u").join(to("v"), "v").select(F.col("u_to").alias("u"), F.col("v_to").alias("v")).filter("u <> v")
        fresh = written(moved.union(moved.select("v", "u")).distinct(), "cc-edges")
        relabelled = written(labels.join(jump.select(F.col("u").alias("component"), "q"), "component", "left").select("id", F.coalesce("q", "component").alias("component")), "cc-labels")
        forget(now, labels, hook, jump)
        now, labels = fresh, relabelled
    forget(now)
    return labels
