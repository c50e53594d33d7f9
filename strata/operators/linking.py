"""Links between tables: alternative keys, pairs by stem, positions, hashes, references, closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.evidence import anchored, held
from strata.operators.ordering import numbers

#: Quotes up to this count and size are broadcast; more meet the texts by their anchors.
MOST_QUOTES, MOST_QUOTE_BYTES = 20_000, 8 << 20


def either_key(rows: DataFrame, pairs: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows that meet any of the one-column tables by the column named with it.

    Each lookup is an equi-join on distinct keys, so no disjunction turns into a nested loop.
    """
    hit = None
    for i, (column, keys) in enumerate(pairs):
        k = keys.select(F.col(keys.columns[0]).alias(f"_k{i}")).distinct()
        rows = rows.join(k, rows[column] == k[f"_k{i}"], "left")
        found = F.col(f"_k{i}").isNotNull()
        hit = found if hit is None else hit | found
    return rows.filter(hit).drop(*[f"_k{i}" for i in range(len(pairs))])


def stem_pairs(left: DataFrame, right: DataFrame, stem: str, order: str) -> DataFrame:
    """(stem, left, right): first row of each stem on both sides, where both have one."""
    a = left.groupBy(stem).agg(F.min(order).alias("left"))
    return a.join(right.groupBy(stem).agg(F.min(order).alias("right")), stem)


def by_position(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, same): values met place by place; a place that one side lacks is not the same."""
    a = left.select(key, order, F.col(value).alias("_a"), F.lit(True).alias("_x"))
    b = right.select(key, order, F.col(value).alias("_b"), F.lit(True).alias("_y"))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return a.join(b, [key, order], "full").select(key, order, (both & F.col("_a").eqNullSafe(F.col("_b"))).alias("same"))


def freshness(recorded: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state) of every recorded row: fresh, stale where its digest differs in more than case, or missing."""
    now = current.select(F.col(key).alias("_k"), F.lower(digest).alias("_d"))
    j = recorded.join(now, F.col(key) == F.col("_k"), "left")
    return j.select(key, F.when(F.col("_k").isNull(), "missing").when(F.lower(digest).eqNullSafe(F.col("_d")), "fresh").otherwise("stale").alias("state"))


def reference_faults(rows: DataFrame, key: str, refs: DataFrame, ref: str) -> DataFrame:
    """(fault, key, n): keys that several rows share, and references to keys that no row has."""
    twice = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("fault"), "key", "n")
    used = refs.filter(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("key")).agg(F.count("*").alias("n"))
    lost = used.join(rows.select(F.col(key).alias("key")).distinct(), "key", "left_anti")
    return twice.union(lost.select(F.lit("dangling").alias("fault"), "key", "n"))


def closure(links: DataFrame, child: str, parent: str, most: int = 64) -> DataFrame:
    """(node, ancestor, depth) over links of a forest, each parent met by equi-joins that double the depth.

    After k rounds all ancestors at a depth up to 2^k are known, so a depth of d takes log2(d) + 1
    rounds. A cycle cannot end; more than ``most`` rounds raise. Lineage is cut where a checkpoint
    directory is set; without one, rounds are cached.
    """
    known = links.filter(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).distinct()
    cut = links.sparkSession.conf.get("spark.checkpoint.dir", None) or links.sparkSession.sparkContext.getCheckpointDir()
    reach = 1
    for _ in range(most):
        # Only the farthest known ancestors can lead on to unknown ones.
        far = known.filter(F.col("depth") == reach).select("node", F.col("ancestor").alias("_via"))
        step = known.select(F.col("node").alias("_via"), "ancestor", (F.col("depth") + reach).alias("depth"))
        more = far.join(step, "_via").select("node", "ancestor", "depth")
        if more.isEmpty():
            return known
        known = known.unionByName(more)
        known = known.checkpoint() if cut else known.cache()
        reach *= 2
    raise ValueError("links form a cycle")


def first_holder(quotes: DataFrame, texts: DataFrame, key: str, quote: str, place: str, text: str, anchor: Column, in_text: Column, unanchored: bool = False) -> DataFrame:
    """(key, how, place): the smallest place whose text equals the quote, else the smallest that contains it.

    ``anchor`` is a value of the quote that occurs among the values ``in_text`` of every text that
    contains it, so that beyond the checked size of a broadcast containment is tested only for pairs that
    share it. Quotes without an anchor are held by equal texts only, or, with ``unanchored``, by containing
    texts too, found by automata of bounded size; what no text holds is ``none``.
    """
    digest = lambda c: F.unhex(F.sha2(F.col(c).cast("binary"), 256))
    q = quotes.select(key, F.col(quote).alias("_q"), anchor.alias("_a"))
    t = texts.select(F.col(place).alias("_place"), F.col(text).alias("_t"), in_text.alias("_in"))
    # Texts meet by their digests, and each digest once, so that neither texts nor pairs of copies are shuffled.
    places = t.groupBy(digest("_t").alias("_d")).agg(F.min("_place").alias("_same")).filter(F.col("_d").isNotNull())
    same = q.select(key, digest("_q").alias("_d")).join(places, "_d").groupBy(key).agg(F.min("_same").alias("_same"))
    left = q.withColumn("_d", digest("_q")).join(places, "_d", "left_anti").drop("_d")
    cut = quotes.sparkSession.conf.get("spark.checkpoint.dir", None) or quotes.sparkSession.sparkContext.getCheckpointDir()
    left = left.checkpoint() if cut else left.cache()
    rest = left.filter(F.col("_a").isNotNull())
    size = rest.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_q")), F.lit(0)).alias("b")).collect()[0]
    if size["n"] <= MOST_QUOTES and size["b"] <= MOST_QUOTE_BYTES:
        found = rest.select(key, "_q").join(held(t, rest, "_t", "_q", "_place"), "_q").groupBy(key).agg(F.min("_place").alias("_held"))
    else:
        found = anchored(rest, t.filter("_place is not null"), key).groupBy(key).agg(F.min("_place").alias("_held"))
    if unanchored:
        loose = left.filter(F.col("_a").isNull() & F.col("_q").isNotNull())
        loose = loose.select(key, "_q").join(held(t, loose, "_t", "_q", "_place"), "_q").select(key, F.col("_place").alias("_held"))
        found = found.unionByName(loose).groupBy(key).agg(F.min("_held").alias("_held"))
    j = quotes.select(key).distinct().join(same, key, "left").join(found, key, "left")
    return j.select(key, F.when(F.col("_same").isNotNull(), "equal").when(F.col("_held").isNotNull(), "within").otherwise("none").alias("how"), F.coalesce("_same", "_held").alias("place"))


def find_records(ids: DataFrame, records: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, how, path): the record <key>.md, else the first in order of paths that names the key.

    A record names a key if its stem contains it or its text has a line ``source_id: key``, back-ticks
    allowed. Stems meet keys by automata, and lines by an equi-join on
    the ids that texts declare. Null keys and paths find nothing.
    """
    k = ids.select(F.col(key).cast("string").alias("_k")).filter(F.length("_k") > 0).distinct()
    r = records.select(F.col(path).alias("_p"), F.regexp_replace(path, r"\.md$", "").alias("_stem"), F.col(text).alias("_t")).filter("_p is not null")
    exact = k.join(r.filter(F.col("_p").endswith(".md")).select(F.col("_stem").alias("_k"), "_p"), "_k").groupBy("_k").agg(F.min("_p").alias("_exact"))
    left = k.join(exact, "_k", "left_anti")
    declared = r.select("_p", F.explode(F.regexp_extract_all("_t", F.lit(r"\bsource_id\b\s*:\s*`?(\w+)"), 1)).alias("_k"))
    line = left.join(declared, "_k").select("_k", "_p")
    within = held(r, left, "_stem", "_k", "_p").select(F.col("_q").alias("_k"), F.col("_place").alias("_p"))
    other = line.unionByName(within).groupBy("_k").agg(F.min("_p").alias("_other"))
    out = ids.select(key).distinct().withColumn("_k", F.col(key).cast("string")).join(exact, "_k", "left").join(other, "_k", "left")
    return out.select(key, F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_other").isNotNull(), "named").otherwise("none").alias("how"), F.coalesce("_exact", "_other").alias("path"))


def numbered(rows: DataFrame, known: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """New rows numbered by their place among all rows of their group, so known ones leave gaps."""
    return numbers(rows, group, order, "seq").withColumn("seq", F.col("seq").cast("int")).join(known.select(key).distinct(), key, "left_anti")
