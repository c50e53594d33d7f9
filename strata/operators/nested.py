"""Nested values: their leaves as rows, comparison of leaves, and a digest that does not depend on field order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def _leaves(value: Column, kind: DataType, path: Column) -> Column:
    if isinstance(kind, StructType):
        parts = [_leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return F.concat(*parts)
    if isinstance(kind, ArrayType):
        at = F.transform(value, lambda x, i: _leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(at), F.array().cast("array<struct<path:string,value:string>>"))
    return F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))


def leaves(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, path, value) of every leaf of a nested column; list items are told apart by position."""
    found = _leaves(F.col(value), df.schema[value].dataType, F.lit("$"))
    return df.select(key, F.explode(found).alias("_l")).select(key, "_l.path", "_l.value")


def compare(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Per path without positions: leaves of the source and how many the target has equal, at the same place."""
    b = target.select(key, "path", F.col("value").alias("_b"), F.lit(True).alias("_y"))
    j = source.join(b, [key, "path"], "left")
    plain = F.regexp_replace("path", r"\[\d+\]", "[]")
    return j.groupBy(plain.alias("path")).agg(F.count("*").alias("total"), F.count_if(F.col("_y").isNotNull() & F.col("value").eqNullSafe(F.col("_b"))).alias("exact"))


def digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with its fields in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def canonical(value: Column, kind: DataType) -> Column:
    """The value with the fields of every struct in the order of their names, at any depth; a null stays null."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    return value


def record_digest(df: DataFrame, name: str) -> Column:
    """SHA-256 of a nested column's JSON with sorted field names: the same for any order of fields; null for null."""
    return F.sha2(F.to_json(canonical(F.col(name), df.schema[name].dataType), {"ignoreNullFields": "false"}), 256)
