"""A worker that tokenises holds a slice of its batch and a bounded memory of words, while it works and after it."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strata.functions import batches
from strata.llm import packing


def task(spark, monkeypatch):
    """What a task of ``packing.pieces`` runs over its Arrow batches."""
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    docs = SimpleNamespace(sparkSession=spark, select=lambda *columns: SimpleNamespace(mapInArrow=lambda run, schema: run))
    return packing.pieces(docs, ids=True)


def test_tokenising_many_distinct_words(spark, monkeypatch):
    run = task(spark, monkeypatch)
    monkeypatch.setattr(packing, "_TOKENIZERS", {})
    packing.tokenizer(packing.default_vocabulary())
    rng, rows, each = np.random.default_rng(4), 100, 50_000
    letters = rng.integers(97, 123, (rows, each), np.uint8)
    letters[:, 8::9] = 32  # half a million words that hardly repeat
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array([x.tobytes().decode() for x in letters])], names=["doc_id", "text"])
    tracemalloc.start()
    lengths = [0] * rows
    for out in run([batch]):
        for doc, n in zip(out.column(1).to_pylist(), out.column(4).to_pylist(), strict=True):
            lengths[doc] += n
    left, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    t = Tokenizer.from_file(packing.default_vocabulary())
    assert lengths == [len(e.ids) + 1 for e in t.encode_batch(batch.column(1).to_pylist(), add_special_tokens=False)]
    assert peak < 50 << 20 and left < 20 << 20, (peak, left)


def test_texts_encoded_few_at_a_time(monkeypatch):
    t = Tokenizer.from_file(packing.default_vocabulary())
    texts = ["", "one", "a longer text than others", "", "two three", "x"]
    for most in (1, 5, 1000):
        monkeypatch.setattr(packing, "AT_ONCE", most)
        assert [x.tolist() for x in packing.encoded(t, texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert list(packing.encoded(t, [])) == []


def test_record_batches_of_the_pipeline_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(sent):
        for b in sent:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    own = spark.newSession()
    corpus_pipeline.pack_sequences(own, own.createDataFrame([], "doc_id long, text string"), "")
    assert own.conf.get(key) == batches.MOST_SENT
    got = own.range(0, 3000, 1, 1).select(F.repeat(F.lit("ab "), F.lit(4000)).alias("text")).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) < 5 << 20
    other = spark.newSession()
    other.conf.set(key, "7m")
    batches.send_little(other)
    assert other.conf.get(key) == "7m"
