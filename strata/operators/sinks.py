"""Results written for other readers, and tables replaced or begun."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cell(c: Column) -> Column:
    """A value as a cell of tab-separated text: tabs and line ends squashed to blanks, null empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\r\n]+", " ")


def tsv_lines(df: DataFrame) -> DataFrame:
    """(value): each row as a line of cells."""
    return df.select(F.concat_ws("\t", *[cell(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


def write_tsv(df: DataFrame, path: str) -> None:
    tsv_lines(df).write.mode("overwrite").text(path)


def read_tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    parts = F.split("value", "\t", -1)
    return spark.read.text(path).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def panel(df: DataFrame, key: str) -> DataFrame:
    """(key, html): each row as a table of names and escaped values."""
    value = cell
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = (lambda f, a, b: lambda c: F.replace(f(c), F.lit(a), F.lit(b)))(value, a, b)
    rows = [F.concat(F.lit(f"<tr><th>{c}</th><td>"), value(F.col(f"`{c}`")), F.lit("</td></tr>")) for c in df.columns]
    return df.select(key, F.concat(F.lit("<table>"), *rows, F.lit("</table>")).alias("html"))


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text, null empty: what a table of varchar columns takes."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def replace_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """Creates or replaces a session-catalogue table of varchar columns, in the warehouse or at a path."""
    out = as_text(df).write.mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(table)


def digest(df: DataFrame) -> Column:
    """An order-free digest of a table's rows, to be aggregated: count and sum of row hashes."""
    row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns])
    return F.concat_ws(":", F.count("*"), F.sum(row.cast("decimal(38,0)")))


def replacement(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """One event row: the table's name, rows and digests before and after, and whether anything changed."""
    a = before.agg(F.count("*").alias("rows_before"), digest(before).alias("_a"))
    b = after.agg(F.count("*").alias("rows_after"), digest(after).alias("_b"))
    return a.join(b).select(F.lit(name).alias("name"), "rows_before", "rows_after", (F.col("_a") != F.col("_b")).alias("changed"))  # one row each


def appended(base: DataFrame, rows: DataFrame) -> DataFrame:
    """base and the rows after it, with base's columns; what rows lack is empty, what they have besides is dropped."""
    return base.unionByName(rows.select(*[F.col(f"`{c}`") for c in rows.columns if c in base.columns]), allowMissingColumns=True)


def begun(spark: SparkSession, table: DataFrame | None, names: list[str]) -> DataFrame:
    """The table, or an empty one with the header where there is none."""
    return table if table is not None else spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only for a local session that names none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = getattr(spark.sparkContext, "_strata_folder", None)
        if not where:
            folder = tempfile.mkdtemp(prefix="strata-shared-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            where = spark.sparkContext._strata_folder = f"file://{folder}"
    return where.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder, for a table that several parts of a plan read; it outlives any executor."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
