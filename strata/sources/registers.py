"""Readers and writers of registers: CSV, markdown tables and bullets, JSON, event logs, files by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.text import strip


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column a stripped string, a missing cell the empty string, a byte-order mark ignored."""
    raw = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(path)
    return raw.select(*[F.coalesce(strip(F.col(f"`{c}`")), F.lit("")).alias(c.lstrip("﻿").strip()) for c in raw.columns])


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields]).write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def lines(text: Column) -> Column:
    """Lines as an array, without a trailing empty one."""
    parts = F.split(text, r"\R")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def table_rows(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, pos, cells map) of markdown pipe tables: first pipe row is the header, rows of another width are dropped."""
    line = files.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line")).withColumn("line", strip(F.col("line"))).filter(F.col("line").startswith("|"))
    cells = line.withColumn("cells", F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), strip)).filter(~F.regexp_replace("line", r"[|:\-\s]", "").eqNullSafe("") | ~F.col("line").contains("---"))
    header = cells.groupBy(key).agg(F.min_by("cells", "pos").alias("header"), F.min("pos").alias("_first"))
    rows = cells.join(header, key).filter((F.col("pos") > F.col("_first")) & (F.size("cells") == F.size("header")))
    return rows.select(key, "pos", F.arrays_zip(F.col("header").alias("name"), F.col("cells").alias("value")).alias("cells"))


def bullets(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, name, value) of bullets ``- **name**: value``, ``- `name`: value`` and ``- name: value``; a name's last line wins."""
    line = files.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    pattern = r"^\s*[-*]\s+(?:\*\*|`)?([^*`:]+)(?:\*\*|`)?\s*:\s*(.*)$"
    found = line.filter(F.col("line").rlike(pattern)).select(key, "pos", F.lower(strip(F.regexp_extract("line", pattern, 1))).alias("name"), strip(F.regexp_extract("line", pattern, 2)).alias("value"))
    return found.groupBy(key, "name").agg(F.max_by("value", "pos").alias("value"))


def section(text: Column, heading: str) -> Column:
    """The text between a numbered heading that matches and the next numbered heading."""
    return F.regexp_extract(text, rf"(?is)(?:^|\n)##\s+\d+\.\s*{heading}[^\n]*\n(.*?)(?=\n##\s+\d+\.|\z)", 1)


def append_events(rows: DataFrame, path: str, mirror: str | None = None) -> None:
    """Appends rows to a log of JSON lines and, where asked for, to its CSV mirror."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)
    if mirror:
        rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns]).write.mode("append").options(header=True, escape='"', emptyValue="").csv(mirror)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    parsed = spark.read.text(path).select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return parsed.filter("e is not null and e._bad is null").select("e.*").drop("_bad")


def files_by_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size, modified) of every file below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def new_files(found: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files whose hash the inventory lacks; the first path of each new hash."""
    return found.join(inventory.select("sha256").distinct(), "sha256", "left_anti").groupBy("sha256").agg(F.min_by(F.struct("path", "size", "modified"), "path").alias("f")).select("sha256", "f.*")
