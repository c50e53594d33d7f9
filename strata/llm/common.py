"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.batches import slices  # noqa: F401  (used by the operators)
from strata.functions.shipping import ship  # noqa: F401  (used by the operators)

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, a directory set on the context, or a local one.

    The last is for tests: a session that is not local must name a folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = getattr(spark.sparkContext, "_strata_dir", None)
        if not where:
            where = spark.sparkContext._strata_dir = "file://" + tempfile.mkdtemp(prefix="strata-shared-")
            atexit.register(_rmtree, where[7:])
    return where.rstrip("/")


def _rmtree(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strata/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strata_path = path
    return out


def settled(df: DataFrame, label: str) -> DataFrame:
    """``written``, after which the tables that an operator's result was read from are deleted."""
    out = written(df, label)
    forget(*getattr(df, "_strata_parts", []))
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_strata_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a few numbers that a broadcast takes at most (some 20 MB in memory).
MOST_BROADCAST = 400_000


def small(table: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if its count allows; beyond, joins shuffle as they would."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def id_crc(col: str | Column, mod: int) -> Column:
    """crc32 of an id written as text, modulo ``mod``; a null id counts as the text 'null'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("null")).cast("binary")) % mod


# --- words of an Arrow string column as 64-bit hashes, without a Python object per word ---

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = _BYTE.copy()
_LOW[:, 65:91] = _BYTE[:, 97:123]
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place_weights(lane: int, n: int) -> np.ndarray:
    """A number for each place in a word.

    They are no powers of a base: modulo 2^64 all powers share factors of two, by which some words (as
    the Thue-Morse word of 1024 letters and its complement) are equal whatever the base.
    """
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE[lane])


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, lower: bool, lanes: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """Hash arrays (one per lane) of all words in the column, and where each row's words begin (n + 1 places)."""
    data, offsets = string_buffer(column)
    n = len(data)
    solid = ~_SPACE[data]
    first = solid.copy()
    if n:
        first[1:] &= ~solid[:-1]
        edge = offsets[1:-1][offsets[1:-1] < n]
        first[edge] |= solid[edge]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in range(lanes)], bounds
    spans = np.diff(np.append(starts, n))
    kind = np.int32 if n < 1 << 31 else np.int64  # arrays of a number per byte are the peak of memory here
    place = np.arange(starts[0], n, dtype=kind)
    place -= np.repeat(starts.astype(kind), spans)
    # bytes after a word's end are white space and weigh nothing
    tab = _LOW if lower else _BYTE
    out = []
    lengths = np.add.reduceat(solid, starts, dtype=np.uint64)
    for k in range(lanes):
        value = tab[k][data[starts[0] :]]
        value *= place_weights(k, int(spans.max()))[place]
        value *= solid[starts[0] :]
        out.append(mix(np.add.reduceat(value, starts - starts[0]) + lengths * np.uint64(0xA24BAED4963EE407)))
    return out, bounds


def window_hashes(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hashes of all windows of k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _BASE[1 - lane]
    out = np.zeros(n, np.uint64)
    if k <= 8:
        for i in range(k):
            out = out * base + h[i : i + n]
        return mix(out)
    # prefix sums with powers; the base is odd, so it has an inverse modulo 2^64
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(base, len(h)))))
    return mix((prefix[k:] - prefix[:-k]) * powers(inverse, n))
