"""Python workers hold slices of a batch, however long its texts are."""

import struct
import threading
import time

import psutil
import pyarrow as pa
from pyspark.sql import functions as F

from strata.functions import batches
from strata.operators import units
from strata.sources import charsets, paratext


def grown(df) -> float:
    """MB that the largest Python worker takes beyond what the largest one had before."""

    def largest() -> float:
        rss = [0]
        for p in psutil.Process().children(recursive=True):
            try:
                if not p.name().startswith("java"):
                    rss.append(p.memory_info().rss)
            except psutil.Error:
                pass
        return max(rss) / 1e6

    before, peak, done = largest(), [0.0], threading.Event()

    def watch():
        while not done.is_set():
            peak.append(largest())
            time.sleep(0.02)

    t = threading.Thread(target=watch)
    t.start()
    df.write.format("noop").mode("overwrite").save()
    done.set()
    t.join()
    return max(peak) - before


def test_slices_of_texts_and_bytes():
    values = [b"a" * 5, None, b"b" * 9, b"", b"c" * 2, b"d" * 2]
    for kind in (pa.binary(), pa.large_binary(), pa.string()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([b"skipped", *values], pa.binary()).cast(kind)], names=["i", "body"]).slice(1)
        got = list(batches.slices([batch.slice(0, 0), batch], 5, "body"))
        assert [b.column(0).to_pylist() for b in got] == [[1, 2], [3], [4, 5, 6]]


def test_controls_of_many_long_texts(spark):
    one = struct.pack("<6H", 65, 13, 0xAC00, 11, 66, 67) * 20000
    df = paratext.tokenized(spark.range(0, 120, 1, 1).select("id", F.lit(one).alias("body")), "body")
    # the tokens at bounds of slices are those of each text alone
    got = df.select(F.size("tokens").alias("n"), "payload_units", "malformed", F.size("to_visible").alias("m"), F.element_at("to_visible", -1).alias("w")).distinct().collect()
    alone = paratext.tokenized(spark.createDataFrame([(0, one)], "id long, body binary"), "body").select(F.size("tokens"), "payload_units", "malformed", F.size("to_visible"), F.element_at("to_visible", -1)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in alone]
    assert grown(df.select(F.size("tokens"))) < 500


def test_units_of_many_long_texts(spark):
    texts = spark.range(0, 400, 1, 1).select("id", F.lit("ab c\n\n" * 40000).alias("text"))
    assert grown(units.chunk(texts, "id")) < 300
    got = units.chunk(texts, "id").groupBy("id").agg(F.count("*").alias("n"), F.max("unit_no").alias("last"), F.sum(F.length("unit_text")).alias("m")).select("n", "last", "m").distinct().collect()
    assert [tuple(r) for r in got] == [(len(c), len(c), sum(map(len, c))) for c in [units.chunk_text("ab c\n\n" * 40000)]]


def test_charsets_of_many_long_texts(spark):
    pages = spark.range(0, 400, 1, 1).select("id", F.encode(F.repeat(F.lit("a\u00e9"), F.lit(100000)), "ISO-8859-1").alias("body"))
    d = charsets.decoded(pages, "body")
    assert [tuple(r) for r in d.groupBy("charset", F.length("text")).count().collect()] == [("latin-1", 200000, 400)]
    assert grown(d) < 200
