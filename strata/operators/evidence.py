"""Evidence: which quotes stand verbatim in stored texts."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.shipping import ship

#: A quote table up to this size is broadcast; a larger one is met through shared word shingles.
MOST_QUOTES, MOST_QUOTE_BYTES = 20_000, 8 << 20
ANCHOR = 4


def held(texts: DataFrame, quotes: DataFrame, text: str, quote: str, place: str) -> DataFrame:
    """(_q, _place): for each distinct quote that a text contains, the smallest place of such a text.

    A block of at most MOST_QUOTES quotes and about MOST_QUOTE_BYTES becomes one automaton, which each task
    runs over its texts once, whatever the number of quotes in it. Quotes beyond one block take more passes.
    Nulls and empty quotes are in no text.
    """
    return _passes(texts, quotes, text, quote, place, every=False).groupBy("_q").agg(F.min("_place").alias("_place"))


def occurrences(texts: DataFrame, quotes: DataFrame, text: str, quote: str, place: str) -> DataFrame:
    """(_q, _place): every distinct quote with every place whose text contains it, by the same passes as ``held``."""
    return _passes(texts, quotes, text, quote, place, every=True)


def _passes(texts: DataFrame, quotes: DataFrame, text: str, quote: str, place: str, every: bool) -> DataFrame:
    ship(texts.sparkSession)
    q = quotes.select(F.col(quote).alias("_q")).filter(F.length("_q") > 0).distinct()
    t = texts.select(F.col(place).alias("_place"), F.col(text).alias("_t")).filter("_place is not null and _t is not null")
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_q")), F.lit(0)).alias("b")).collect()[0]
    blocks = max(1, -(-size["n"] // max(1, MOST_QUOTES)), -(-size["b"] // MOST_QUOTE_BYTES))
    kind = t.schema["_place"].dataType.simpleString()
    found = []
    for b in range(blocks):
        part = q.filter(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b) if blocks > 1 else q
        needles = texts.sparkSession.sparkContext.broadcast([r["_q"] for r in part.collect()])
        found.append(t.mapInArrow(_scan(needles, pa.string() if kind == "string" else pa.int64(), every), f"_q string, _place {'string' if kind == 'string' else 'long'}"))
    return reduce(DataFrame.unionByName, found)


def _scan(needles, kind: pa.DataType, every: bool):
    """Runs an automaton of the broadcast needles over (place, text); each pair, or each needle's least place in the task."""

    def apply(batches):
        import ahocorasick

        words, machine = needles.value, ahocorasick.Automaton()
        for i, x in enumerate(words):
            machine.add_word(x, i)
        if words:
            machine.make_automaton()
        least: dict = {}
        for batch in batches if words else ():
            hits = [(i, at) for at, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i in {i for _, i in machine.iter(body)}]
            if every:
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i, _ in hits], pa.string()), pa.array([at for _, at in hits], kind)], names=["_q", "_place"])
                continue
            for i, at in hits:
                least[i] = min(at, least.get(i, at))
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in least], pa.string()), pa.array(list(least.values()), kind)], names=["_q", "_place"])

    return apply


def anchored(quotes: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, _place) of the quotes (key, _q, _a) that texts (_place, _t, _in) contain, met by their anchors.

    A quote's anchor is among the values ``_in`` of every text that contains it. Anchors travel with places
    only, and each pair of quote and place is made once; texts and quotes come to their pairs afterwards, so
    that no text is shuffled with its anchors.
    """
    spots = texts.select("_place", F.explode(F.array_distinct("_in")).alias("_a"))
    pairs = spots.join(quotes.select(key, "_a"), "_a").select(key, "_place").distinct()
    near = pairs.join(quotes.select(key, "_q"), key).join(texts.select("_place", "_t"), "_place")
    return near.filter(F.contains("_t", F.col("_q"))).select(key, "_place").distinct()


def _anchor_words(c):
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def supported(quotes: DataFrame, evidence: DataFrame, key: str, quote: str = "text", text: str = "text") -> DataFrame:
    """Keys of quotes that some evidence text contains verbatim.

    A small quote table (its count and bytes are checked) is found in one pass of an automaton. A larger one
    meets the evidence in an equi-join on an inner shingle of ANCHOR words, which any text that contains the
    quote has too, before the containment test; quotes of fewer than ANCHOR + 2 words have no such shingle
    and take passes of automata of bounded size.
    """
    q = quotes.select(F.col(key), F.col(quote).alias("_q")).filter(F.length("_q") > 0)
    e = evidence.select(F.col(text).alias("_t")).filter(F.col("_t").isNotNull())
    here = e.withColumn("_at", F.lit(0))
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_q")), F.lit(0)).alias("b")).collect()[0]
    if size["n"] <= MOST_QUOTES and size["b"] <= MOST_QUOTE_BYTES:
        return q.join(held(here, q, "_t", "_q", "_at"), "_q").select(key).distinct()
    words = _anchor_words(F.col("_q"))
    long = q.withColumn("_w", words).filter(F.size("_w") >= ANCHOR + 2).withColumn("_a", F.array_join(F.slice("_w", 2, ANCHOR), " ")).drop("_w")
    texts = e.select(F.xxhash64("_t").alias("_place"), "_t", _anchor_words(F.col("_t")).alias("_w")).filter(F.size("_w") >= ANCHOR)
    shingles = F.transform(F.sequence(F.lit(1), F.size("_w") - ANCHOR + 1), lambda i: F.array_join(F.slice("_w", i, ANCHOR), " "))
    found = anchored(long, texts.select("_place", "_t", shingles.alias("_in")), key).select(key)
    short = q.filter(F.size(words) < ANCHOR + 2)
    return found.union(short.join(held(here, short, "_t", "_q", "_at"), "_q").select(key)).distinct()


def unsupported(quotes: DataFrame, evidence: DataFrame, key: str, **how) -> DataFrame:
    return quotes.select(key).join(supported(quotes, evidence, key, **how), key, "left_anti")
