"""Files of a folder as rows, without their contents, and what of them patterns name."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow.fs as files_of
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.shipping import ship


def resolved(path: Column) -> Column:
    """A path without empty parts, single points, and parts that a double point takes back."""
    step = lambda done, part: F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).when(part == "..", done).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _qualified(spark: SparkSession, root: str) -> str:
    """A folder with its store, which a path alone takes from the session's default."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def written(df: DataFrame, root: str, folders: list[str], value: str) -> None:
    """Writes a text file for each row, in folders name=value of some columns below root; a folder gets one file if its rows differ in none of these columns.

    All tasks write. Hadoop starts a process or two for each file that it creates on a local disk, to set its mode,
    so that files below a file: root are written as files; any other store gets them by Spark's own writer.
    """
    spark = df.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    dealt = df.select(*[F.col(c).cast("string").alias(c) for c in folders], value).repartition(tasks, *folders)
    whole = _qualified(spark, root)
    if not whole.startswith("file:"):
        dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*folders).text(root)
        return
    ship(spark)
    base = re.sub(r"^file:/+", "/", whole)

    def put(rows):
        disk, texts = files_of.LocalFileSystem(), {}
        for r in rows:
            texts.setdefault("/".join(f"{c}={r[c]}" for c in folders), []).append((r[value] or "") + "\n")
        for folder, lines in texts.items():
            disk.create_dir(f"{base}/{folder}")
            # the same name whenever the task is run again
            with disk.open_output_stream(f"{base}/{folder}/part.txt") as f:
                f.write("".join(lines).encode())

    dealt.foreachPartition(put)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of every file below a folder, paths relative to it; no content is read."""
    # folders are listed by some tasks for each core; by default Spark starts a task for each folder, up to ten thousand
    tasks, before = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    try:
        spark.conf.set(tasks, str(4 * spark.sparkContext.defaultParallelism))
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    finally:
        spark.conf.set(tasks, before)
    base = re.sub(r"^file:/+", "file:/", _qualified(spark, root))
    bare = F.regexp_replace("path", r"^file:/+", "file:/")
    return files.select(F.when(bare.startswith(base), F.substr(bare, F.lit(len(base) + 2))).otherwise(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def glob(pattern: str) -> str:
    """A regular expression for a pattern on relative paths: * and ? stay within a part, ** stands for any number of parts, [..] is a class."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", "\\^")) + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def named(files: DataFrame, patterns: list[tuple[str, str, bool]]) -> DataFrame:
    """(place, role, path, required, present): the files that patterns (role, pattern, required) name, in order.

    Each file counts once, under the first pattern that names it; paths are compared resolved. ``place`` numbers
    the rows of a pattern in order of path. A required pattern that names no file at all gives a row with the
    pattern for its path that is not present. The patterns are conditions in the plan: one pass over the files.
    """
    f = files.select(resolved(F.col("path")).alias("path")).distinct()
    hits = [F.col("path").rlike(glob(p)) for _, p, _ in patterns]
    first = reduce(lambda acc, x: acc.when(x[1], x[0]), list(enumerate(hits))[1:], F.when(hits[0], 0))
    pick = lambda k: F.get(F.array(*[F.lit(p[k]) for p in patterns]), F.col("_at"))
    found = f.withColumn("_at", first).filter("_at is not null")
    place = (F.row_number().over(Window.partitionBy("_at").orderBy("path")) - 1).cast("int")
    rows = found.select(place.alias("place"), pick(0).alias("role"), "path", pick(2).alias("required"), F.lit(True).alias("present"))
    counts = f.agg(*[F.count_if(h).alias(f"_{i}") for i, h in enumerate(hits)])
    needed = [F.when(F.coalesce(F.col(f"_{i}"), F.lit(0)) == 0, F.struct(F.lit(0).alias("place"), F.lit(r).alias("role"), F.lit(p).alias("path"), F.lit(True).alias("required"), F.lit(False).alias("present"))) for i, (r, p, need) in enumerate(patterns) if need]
    if not needed:
        return rows
    return rows.unionByName(counts.select(F.explode(F.array_compact(F.array(*needed))).alias("r")).select("r.*"))
