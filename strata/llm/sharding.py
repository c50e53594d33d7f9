"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Groups (equal texts) are summed with a partial aggregate, dealt by hash into blocks of bounded size, and
each block is differenced on its own: the two partial partitions of largest spread are merged again and
again, the heaviest part of one with the lightest of the other. What a block leaves is one partial
partition (a row of shard sums); those are dealt into blocks and differenced in the same way, level by
level, until one block is left. All of it runs in executors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, ship, small, written

#: Groups in a block, on average.
BLOCK = 20_000
#: Partial partitions that are differenced at once on the levels above.
WIDE = 2_000
#: Rows in one numbering unit of a shard, on average.
UNIT = 50_000


def difference(sums: list[tuple[float, ...]]) -> list[list[int]]:
    """Karmarkar-Karp over partial partitions: for each one the final part of each of its parts.

    sums: k-tuples, one per partial partition. Ties go to the partition that comes first.
    """
    if not sums:
        return []
    k = len(sums[0])
    heap = []
    for i, s in enumerate(sums):
        order = sorted(range(k), key=lambda p: (-s[p], p))
        heap.append((-(s[order[0]] - s[order[-1]]), i, [s[p] for p in order], [[(i, p)] for p in order]))
    heapq.heapify(heap)
    n = len(sums)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        parts = []
        for j in range(k):
            u, v = x[j], y[k - 1 - j]
            if len(u) < len(v):
                u, v = v, u
            u.extend(v)
            parts.append((a[j] + b[k - 1 - j], u))
        parts.sort(key=lambda p: -p[0])
        n += 1
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, [p[0] for p in parts], [p[1] for p in parts]))
    out = [[0] * k for _ in sums]
    for final, members in enumerate(heap[0][3]):
        for i, p in members:
            out[i][p] = final
    return out


def assign_groups(groups: DataFrame, shards: int) -> tuple[DataFrame, list[DataFrame]]:
    """(gkey, gsize) to (gkey, shard), and the tables it reads. gkey is a hash; each group has one row."""
    n = groups.count()
    blocks = max(1, -(-n // BLOCK))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gsize", "gkey"], ascending=[False, True], kind="stable")
        sizes = pdf["gsize"].tolist()
        parts = [p[0] for p in difference([(float(s), *[0.0] * (shards - 1)) for s in sizes])]
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "gkey": pdf["gkey"].to_numpy(), "gsize": sizes, "part": np.array(parts, np.int32)})

    dealt = groups.withColumn("block", F.pmod(F.xxhash64("gkey"), F.lit(blocks)))
    local = written(dealt.groupBy("block").applyInPandas(block, "block long, gkey string, gsize long, part int"), "kk")
    sums = local.groupBy(F.col("block").alias("item")).agg(F.array(*[F.sum(F.when(F.col("part") == p, F.col("gsize")).otherwise(0)).cast("double") for p in range(shards)]).alias("sums"))
    final = written(places(sums, shards), "places")
    placed = local.join(small(final), F.col("block") == F.col("item")).select("gkey", F.element_at("final", F.col("part") + 1).alias("shard"))
    return placed, [local, final]


def places(sums: DataFrame, shards: int) -> DataFrame:
    """(item, final) from (item, sums): the shard of each part of every partial partition, by levels of blocks."""

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        final = difference([tuple(s) for s in pdf["sums"]])
        moved = [[float(s[f.index(p)]) for p in range(shards)] for s, f in zip(pdf["sums"], final, strict=True)]
        return pd.DataFrame({"item": pdf["item"], "up": pdf["up"], "final": final, "moved": moved})

    sums = written(sums, "sums")
    blocks = max(1, -(-sums.count() // WIDE))
    dealt = sums.withColumn("up", F.pmod(F.xxhash64("item", F.lit(blocks)), F.lit(blocks)))
    here = written(dealt.groupBy("up").applyInPandas(level, "item long, up long, final array<int>, moved array<double>"), "level")
    forget(sums)
    if blocks == 1:
        return here.select("item", "final")
    above = here.groupBy(F.col("up").alias("item")).agg(F.array(*[F.sum(F.col("moved")[p]) for p in range(shards)]).alias("sums"))
    above = places(above, shards).toDF("up", "top")
    return here.join(above, "up").select("item", F.transform("final", lambda f: F.element_at("top", f + 1)).alias("final"))


def shard(docs: DataFrame, shards: int = 16, text: str = "text") -> DataFrame:
    """docs with size, text_crc32, shard and slot, equal texts together and the shards' bytes near equal.

    Size is the text's UTF-8 bytes plus 1; a null text is an empty one. Rows of equal text form one
    group however many they are. Slots number a shard's rows from 0 without gaps. An empty table gives
    an empty one; columns of docs named like those added are replaced.
    """
    ship(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    added = ("size", "text_crc32", "gkey", "shard", "slot", "_unit")
    sized = docs.select(*[c for c in docs.columns if c not in added], (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("gkey"))
    if text in sized.columns and text != "doc_id":
        sized = sized.drop(text)
    sized = written(sized, "sized")
    groups = sized.groupBy("gkey").agg(F.sum("size").alias("gsize"))
    assigned, parts = assign_groups(groups, shards)
    units = max(1, -(-sized.count() // (UNIT * shards)))
    keys = [c for c in ("doc_id", "gkey") if c in sized.columns]
    placed = sized.join(assigned, "gkey").withColumn("_unit", F.pmod(F.xxhash64(*keys, F.lit(0)), F.lit(units)).cast("int"))
    placed = written(placed, "placed")
    forget(sized, *parts)
    before = Window.partitionBy("shard").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "_unit").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("shard", "_unit").orderBy(*keys)
    out = placed.withColumn("_n", F.row_number().over(order)).join(small(written(offsets, "offsets")), ["shard", "_unit"])
    return out.withColumn("slot", F.col("_start") + F.col("_n") - 1).drop("_unit", "_start", "_n")


def query(docs: DataFrame) -> DataFrame:
    out = shard(docs.select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
