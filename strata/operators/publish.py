"""Tables replaced as a whole: written aside, verified, then published by one rename of a manifest.

A published table is a folder with its versions, a manifest that names the current one, and events. Readers go
by the manifest, so that they see the old version or the new one, whole. Everything goes through Spark's
writers and the Hadoop file system, to whatever store the path is in.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.operators.sinks import digest

EVENT = "event int, state string, rows_before long, rows_after long, digest_before string, digest_after string, changed boolean"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_whole(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file aside and renames it over the one that is there."""
    jvm = spark._jvm
    fs, part = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), spark._jsc.hadoopConfiguration())
    option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    context.rename(part, jvm.org.apache.hadoop.fs.Path(path), options)


def _read_whole(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    opened = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode()
    finally:
        opened.close()


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What is published at a folder: version, rows, digest and the number of its last event; None where nothing is."""
    text = _read_whole(spark, f"{root}/current.json")
    return json.loads(text) if text else None


def current(spark: SparkSession, root: str) -> DataFrame:
    """The published rows."""
    now = manifest(spark, root)
    if now is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    return spark.read.parquet(f"{root}/versions/{now['version']}")


def events(spark: SparkSession, root: str) -> DataFrame:
    """(event, state, rows and digests before and after, changed) of every attempt, in order of event."""
    return spark.read.schema(EVENT).json(f"{root}/events")


def publish(df: DataFrame, root: str) -> dict:
    """Replaces what is published at a folder by df, and says what changed in an event.

    Rows are counted and their digest is taken while they are written aside; what was written is read back and
    must agree before the manifest names it. If writing or verifying fails, the old version stays, what was
    written aside is deleted, the event says ``failed`` and the error is raised. One writer at a time is
    assumed; of two, the later rename wins, and no reader sees a mixture.
    """
    spark = df.sparkSession
    before = manifest(spark, root) or {"version": None, "rows": 0, "digest": None, "event": 0}
    name, event = uuid.uuid4().hex, before["event"] + 1
    stage, final = f"{root}/staged/{name}", f"{root}/versions/{name}"

    def said(state: str, rows: int, after: str | None) -> None:
        line = {"event": event, "state": state, "rows_before": before["rows"], "rows_after": rows, "digest_before": before["digest"], "digest_after": after, "changed": after != before["digest"]}
        _write_whole(spark, f"{root}/events/{event:08d}-{name}.json", json.dumps(line) + "\n")

    try:
        seen = Observation()
        df.observe(seen, F.count("*").alias("n"), digest(df).alias("d")).write.parquet(stage)
        want = seen.get
        back = spark.read.schema(df.schema).parquet(stage)
        got = back.agg(F.count("*").alias("n"), digest(back).alias("d")).first()
        if (got["n"], got["d"]) != (want["n"], want["d"]):
            raise OSError(f"what was written to {stage} does not agree with what was to be written")
        fs, source = _fs(spark, stage)
        _, target = _fs(spark, final)
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"could not rename {stage}")
    except Exception:
        fs, source = _fs(spark, stage)
        fs.delete(source, True)
        said("failed", before["rows"], before["digest"])
        if before["version"]:
            _write_whole(spark, f"{root}/current.json", json.dumps(before | {"event": event}))
        raise
    now = {"version": name, "rows": got["n"], "digest": got["d"], "event": event, "previous": before["version"]}
    _write_whole(spark, f"{root}/current.json", json.dumps(now))
    said("published", got["n"], got["d"])
    return now


def prune(spark: SparkSession, root: str) -> int:
    """Deletes versions that the manifest names neither as current nor as previous, and what lies staged; returns how many."""
    now = manifest(spark, root) or {}
    keep, gone = {now.get("version"), now.get("previous")}, 0
    for part in ("versions", "staged"):
        fs, folder = _fs(spark, f"{root}/{part}")
        if fs.exists(folder):
            for status in fs.listStatus(folder):
                if part == "staged" or status.getPath().getName() not in keep:
                    gone += bool(fs.delete(status.getPath(), True))
    return gone
