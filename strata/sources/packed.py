"""Packed little-endian numbers: single fields as expressions, arrays of fixed-width records a batch at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.shipping import ship

#: The fields of a line segment (fixed values of the public format), 36 bytes each.
LINE_SEGMENT = (("textpos", "u4"), ("vertpos", "i4"), ("vertsize", "i4"), ("textheight", "i4"), ("baseline", "i4"), ("spacing", "i4"), ("horzpos", "i4"), ("horzsize", "i4"), ("flags", "u4"))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f reads it; the code Spark makes for f does not grow with that."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _reversed(b: Column) -> Column:
    """The bytes of a binary value in reverse."""
    return F.encode(F.reverse(F.decode(b, "ISO-8859-1")), "ISO-8859-1")


def number(body: Column, at: Column | int, width: int, signed: bool = False) -> Column:
    """The little-endian number of ``width`` bytes (up to 4) at a place of a binary value; null where it ends before."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = [F.hex(F.substring(body, at + 1 + i, F.lit(1))) for i in reversed(range(width))]
    value = F.conv(F.concat(*digits) if width > 1 else digits[0], 16, 10).cast("long")
    if signed:
        value = F.shiftright(F.shiftleft(value, 64 - 8 * width), 64 - 8 * width)
    return F.when((at >= 0) & (F.octet_length(body) >= at + width), value)


def packed(*fields: tuple[Column | int, int]) -> Column:
    """Binary of (value, width in bytes) one after another, little-endian; negative values as their complement.

    Numbers are written from the last to the first, the high byte first, and their bytes reversed together.
    """
    parts: list[Column | str] = []
    for value, width in reversed(fields):
        if isinstance(value, int):
            digits = (value & ((1 << 8 * width) - 1)).to_bytes(width, "big").hex().upper()
            parts[-1:] = [parts[-1] + digits] if parts and isinstance(parts[-1], str) else [*parts[-1:], digits]
        else:
            v = value.cast("long")
            parts.append(F.lpad(F.hex(v if width >= 8 else v.bitwiseAND(F.lit((1 << 8 * width) - 1))), 2 * width, "0"))
    return _reversed(F.unhex(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])))


def bit(flags: Column, place: int) -> Column:
    return F.shiftright(flags, place).bitwiseAND(F.lit(1)) == 1


def records(df: DataFrame, column: str, fields: tuple[tuple[str, str], ...], name: str = "records") -> DataFrame:
    """df with ``name``, the fixed-width records that a binary column holds, and ``name``_rest, the bytes left over.

    ``fields`` are (name, kind) with numpy's kinds u1 u2 u4 i1 i2 i4, little-endian without gaps; numbers come
    out as longs. The bytes of a batch are laid side by side and decoded at once, without a step a record. A null
    binary has null records and null bytes left over; one shorter than a record has none and all bytes left over.
    """
    ship(df.sparkSession)
    kind = np.dtype([(n, "<" + k) for n, k in fields])
    item = T.StructType([T.StructField(n, T.LongType()) for n, _ in fields])
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(item)), T.StructField(f"{name}_rest", T.LongType())])

    def decode(batches):
        for batch in batches:
            body = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
            lost = body.is_null().to_numpy(zero_copy_only=False)
            body = body.fill_null(b"")
            ends = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1, body.offset * 8) if len(body) else np.zeros(1, np.int64)
            sizes = np.diff(ends)
            counts = sizes // kind.itemsize
            data = np.frombuffer(body.buffers()[2], np.uint8) if body.buffers()[2] is not None else np.zeros(0, np.uint8)
            # where the bytes of whole records are
            first = np.repeat(ends[:-1], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * kind.itemsize
            whole = data[first[:, None] + np.arange(kind.itemsize)].reshape(-1).view(kind) if len(first) else np.zeros(0, kind)
            items = pa.StructArray.from_arrays([pa.array(whole[n].astype(np.int64)) for n, _ in fields], [n for n, _ in fields])
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), mask=np.append(lost, False))
            rest = pa.array(sizes - counts * kind.itemsize, pa.int64(), mask=lost)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, items), rest], names=[*batch.schema.names, name, f"{name}_rest"])

    return df.mapInArrow(decode, schema)


def line_segments(df: DataFrame, body: str, declared: str) -> DataFrame:
    """df with ``segments``, ``segments_rest`` and ``status``: parsed, declared_count_mismatch or trailing_bytes; null without a body."""
    out = records(df, body, LINE_SEGMENT, "segments")
    status = F.when(F.col("segments_rest") > 0, "trailing_bytes").when(F.size("segments") != F.coalesce(F.col(declared), F.lit(0)), "declared_count_mismatch").otherwise("parsed")
    return out.withColumn("status", F.when(F.col("segments").isNotNull(), status))
