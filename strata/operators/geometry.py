"""Affine maps of nested shapes: products in order, products along chains of parents, boxes clamped to a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators import sinks

#: A map takes (x, y) to (a x + b y + c, d x + e y + f).
PARTS = "abcdef"
#: The kind of a matrix whose scale counts for a shape's size (a fixed value of the public format).
SCALE = "scaMatrix"


def affine(values: list) -> Column:
    """A map of six numbers or columns."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in zip(PARTS, values, strict=True)])


IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def then(first: Column, second: Column) -> Column:
    """The map that does ``first`` and then ``second``."""
    p, q = first, second
    return affine([
        q["a"] * p["a"] + q["b"] * p["d"], q["a"] * p["b"] + q["b"] * p["e"], q["a"] * p["c"] + q["b"] * p["f"] + q["c"],
        q["d"] * p["a"] + q["e"] * p["d"], q["d"] * p["b"] + q["e"] * p["e"], q["d"] * p["c"] + q["e"] * p["f"] + q["f"],
    ])


def composed(matrices: Column) -> Column:
    """(map, scale_x, scale_y) of an array of (kind, m) done one after another; only matrices of kind SCALE scale the size.

    A null matrix does nothing; a null or empty array is the identity.
    """
    start = F.struct(affine(list(IDENTITY)).alias("map"), F.lit(1.0).alias("scale_x"), F.lit(1.0).alias("scale_y"))
    scales = lambda t, part: F.when(t["kind"] == SCALE, F.abs(t["m"][part])).otherwise(1.0)
    step = lambda s, t: F.struct(then(s["map"], t["m"]).alias("map"), (s["scale_x"] * scales(t, "a")).alias("scale_x"), (s["scale_y"] * scales(t, "e")).alias("scale_y"))
    return F.coalesce(F.aggregate(F.filter(matrices, lambda t: t["m"].isNotNull()), start, step), start)


def placed(shapes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth, map, scale_x, scale_y) of shapes (node, parent, map, scale_x, scale_y): maps done from the shape up to its root.

    Maps do not commute, so that a chain is a product in order; it is taken in doubling steps, each a join of
    what is known with itself, one for each doubling of the greatest depth. A parent that is no node ends a chain.
    Shapes on a cycle of parents have no root and are left out. Steps are written to the shared folder.
    """
    s = shapes.select(F.col(node).alias("node"), F.col(parent).alias("up"), "map", "scale_x", "scale_y")
    known = s.select(F.col("node").alias("up"), F.lit(True).alias("_is"))
    now = s.join(known, "up", "left").select("node", F.when(F.col("_is"), F.col("up")).alias("up"), F.col("node").alias("root"), F.lit(0).alias("depth"), "map", "scale_x", "scale_y")
    now = sinks.kept(now, "placed")
    open_before = None
    while True:
        still = now.filter("up is not null").count()
        if still == 0 or still == open_before:  # what is left are cycles and what hangs below them
            return now.filter("up is null").drop("up").withColumnRenamed("node", node)
        open_before = still
        far = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("map").alias("_map"), F.col("scale_x").alias("_x"), F.col("scale_y").alias("_y"))
        j = now.join(far, "up", "left")
        met = F.col("_root").isNotNull()
        now = sinks.kept(
            j.select(
                "node", F.col("_up").alias("up"), F.when(met, F.col("_root")).otherwise(F.col("root")).alias("root"), (F.col("depth") + F.when(met, F.col("_depth") + 1).otherwise(0)).alias("depth"),
                F.when(met, then(F.col("map"), F.col("_map"))).otherwise(F.col("map")).alias("map"), (F.col("scale_x") * F.coalesce("_x", F.lit(1.0))).alias("scale_x"), (F.col("scale_y") * F.coalesce("_y", F.lit(1.0))).alias("scale_y"),
            ),
            "placed",
        )


def box(width: Column, height: Column, at: Column, scale_x: Column, scale_y: Column, group_width: Column, group_height: Column, layer: Column) -> Column:
    """(left, top, width, height) of a shape on its group: where its map takes the origin, scaled, kept within the group.

    Halves go to even. A shape that would stand out above or below is put near the top instead, lower for each layer
    after the first. Nothing is smaller than 1.
    """
    whole = lambda c: F.bround(c).cast("long")
    least = lambda c: F.greatest(F.lit(1), c)
    w, h = least(whole(least(width) * scale_x)), least(whole(least(height) * scale_y))
    left = F.greatest(F.lit(0), F.least(whole(at["c"]), F.greatest(F.lit(0), group_width - w)))
    shelf = (group_height * F.when(layer == 0, F.lit(0.015)).otherwise(0.085 + 0.02 * (layer - 1))).cast("long")
    y = whole(at["f"])
    top = F.greatest(F.lit(0), F.when((y < 0) | (y + h > group_height), shelf).otherwise(y))
    return F.struct(left.alias("left"), top.alias("top"), F.least(w, least(group_width - left)).alias("width"), F.least(h, least(group_height - top)).alias("height"))
