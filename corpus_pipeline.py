"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.batches import send_little
from strata.llm import common, minhash, mixing, packing, substrings, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not predict to be toxic.

    All columns of docs come out as they are, also ones named like the model's. Null and empty texts are
    scored as texts without words and stay unless the model says otherwise; rows that repeat are scored
    alike; an empty table gives an empty one.
    """
    send_little(spark)
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score="_toxic_score", predicted="_toxic").filter("_toxic = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at similarity 0.8 or more: the one with the smallest doc_id.

    Rows that repeat a doc_id are judged each by its own text; of rows with equal doc_id and text the one
    whose other columns come first stays. Rows without a doc_id, and texts without words, stay. An empty
    table gives an empty one.
    """
    send_little(spark)
    found = common.settled(minhash.near_duplicates(docs, percent=80), "found")
    key = F.xxhash64("text")
    gone = common.written(found.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "gone")
    again = common.written(found.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).count().filter("count > 1").drop("count"), "again")
    common.forget(found)
    on = lambda t: (docs["doc_id"] == t["_id"]) & (key == t["_key"])
    left = docs.join(common.small(gone), on(gone), "left_anti")
    if again.isEmpty():
        return left
    few = common.small(again)
    order = Window.partitionBy("doc_id", key).orderBy(*[F.to_json(F.struct(c)) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0))
    once = left.join(few, on(few), "left_semi").withColumn("_strata_row", F.row_number().over(order)).filter("_strata_row = 1").select(*docs.columns)
    return left.join(few, on(few), "left_anti").unionByName(once)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of long passages that a document with a smaller doc_id has too; n_chars follows the text.

    Null and empty texts stay as they are, and so do rows without a doc_id; no row is dropped. Rows that
    repeat a doc_id are judged each by its own text. An empty table gives an empty one.
    """
    send_little(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substrings.remove_repeats(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_strata"), *rest).alias("_strata_rest")))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_strata_rest")["n_chars"])
    done = out.select(*[columns.get(c, F.col("_strata_rest")[c]).alias(c) for c in docs.columns])
    done._strata_parts = out._strata_parts
    return done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says.

    Null and blank texts have size 0 and are taken like any other row of their source; a null source is one
    of its own. Rows that repeat a doc_id draw alike. An empty table gives an empty one.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents: their token ids, and the sequence and the offset they are packed to.

    Null and empty texts are the end id alone. Rows that repeat are packed one by one. An empty table gives
    an empty one.
    """
    send_little(spark)
    return packing.pack_documents(docs, ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = common.settled(stage(spark, docs, sf_dir), f"stage-{name}")
        common.forget(docs)
        docs = done
    return docs
