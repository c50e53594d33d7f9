"""Routing of free-text requests to catalogue entries by weighted cues."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import fold_key
from strata.operators.evidence import occurrences

#: Weight of a hit by the cue's kind (fixed values).
WEIGHTS = {"example": 6.0, "description": 4.0, "direct": 3.0, "positive": 2.0, "negative": -3.0}
LEAST_SCORE, MARGIN = 2.5, 1.5


def route(requests: DataFrame, cues: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, outcome, target, score): matched, ambiguous (below the least score, or others within the margin) or not_found.

    cues: target, position, kind, cue. A target counts if its cues sum to more than 0; without one, a request
    is not found. Cues are found in one pass of an automaton over the requests, more of them in more passes;
    a null or empty cue counts for nothing. Scores sum per target, and a request's targets are compared by
    aggregates, not by sorting all requests.
    """
    weight = F.element_at(F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    low = cues.select("target", "position", weight.alias("_w"), F.lower("cue").alias("_q"))
    texts = requests.select(F.to_json(F.struct(key)).alias("_k"), F.lower(F.coalesce(text, F.lit(""))).alias("_t"))
    keys = requests.select(key, F.to_json(F.struct(key)).alias("_place")).distinct()
    hits = occurrences(texts, low, "_t", "_q", "_k").join(low, "_q").join(keys, "_place")
    scores = hits.groupBy(key, "target", "position").agg(F.sum("_w").alias("score")).filter("score > 0")
    w = Window.partitionBy(key)
    ranked = scores.withColumn("_best", F.max(F.struct("score", (-F.col("position")).alias("p"), "target")).over(w))
    near = ranked.groupBy(key).agg(F.max("_best").alias("b"), F.count_if(F.col("score") >= F.col("_best.score") - MARGIN).alias("n"))
    out = requests.select(key).join(near, key, "left")
    found = F.coalesce(F.col("b.score") >= LEAST_SCORE, F.lit(False))
    return out.select(key, F.when(F.col("b").isNull(), "not_found").when(~found | (F.col("n") > 1), "ambiguous").otherwise("matched").alias("outcome"), F.when(found, F.col("b.target")).alias("target"), F.when(found, F.col("b.score")).alias("score"))


def by_alias(requests: DataFrame, query: str, aliases: list[tuple[str, str, str]]) -> DataFrame:
    """(query, target, tier) by the first tier that an alias meets, both without case, blanks, underscores and hyphens.

    Tier 0: a term on hold equals, contains or is within the query; 1: an alias equals it; 2: an alias contains
    it; 3: an alias of at least four characters is within it, the longest first. Within a tier the
    catalogue's order decides. An empty query meets nothing. The catalogue is configuration, so its entries
    are literals of one expression.
    """
    q, picks = fold_key(F.coalesce(F.col(query), F.lit(""))), []
    for i, (kind, name, target) in enumerate(aliases):
        alias = re.sub(r"[\s_\-]+", "", name.strip().lower())
        if not alias:
            continue
        inside, around = F.contains(q, F.lit(alias)), F.contains(F.lit(alias), q)
        if kind == "hold":
            tier = F.when(inside | around, 0)
        else:
            tier = F.when(q == alias, 1).when(around, 2)
            if len(alias) >= 4:
                tier = tier.when(inside, 3)
        rank = F.struct(tier.alias("tier"), F.when(tier == 3, -len(alias)).otherwise(0).alias("n"), F.lit(i).alias("i"), F.lit(target).alias("target"))
        picks.append(F.when(tier.isNotNull() & (q != ""), rank))
    best = requests.select(query, F.array_min(F.array_compact(F.array(*picks))).alias("_b"))
    return best.select(query, F.col("_b.target").alias("target"), F.col("_b.tier").alias("tier"))
