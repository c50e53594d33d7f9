"""Register headers under their canonical names, by ordered rules of which the first that matches decides."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import clean_cell, strip
from strata.operators.sinks import kept

#: Canonical name and its marks. ``=x`` is the whole header, ``^x`` its beginning, anything
#: else a part of the header: as it is if the mark has a blank, with blanks as underscores if not. A plural header ``source_ids`` falls to the
#: first rule and is kept as ``source_id``; its values are lists.
RULES: dict[str, list[tuple[str, list[str]]]] = {
    "integrity": [
        ("source_id", ["source_id"]), ("source_ids", ["source_ids", "주요_증거"]), ("title", ["^원본 자료명", "source_title", "=title"]), ("publisher", ["발행", "publisher"]),
        ("reliability_tier", ["신뢰도", "tier", "reliability"]), ("status", ["=status", "readiness"]), ("capture_path", ["capture_path"]),
        ("local_original_path", ["local_original_path", "original_file_path", "original_path"]), ("url_or_path", ["local_path", "로컬_보관_경로", "url_or_path"]), ("url", ["=official_url"]),
        ("source_locator", ["source_locator"]), ("claim_id", ["claim_id"]), ("claim_type", ["claim_type", "주장_유형", "=type", "classification", "분류"]), ("evidence_class", ["evidence_class"]),
        ("original_verified", ["original_verified"]), ("exact_quote_location", ["exact_quote_location"]), ("report_use_allowed", ["report_use_allowed"]),
    ],
    "quality": [
        ("source_id", ["source_id"]), ("source_ids", ["source_ids", "주요_증거"]), ("claim_id", ["claim_id"]), ("claim_type", ["claim_type", "classification", "분류"]), ("status", ["=status", "readiness", "상태"]),
        ("evidence_class", ["evidence_class"]), ("original_verified", ["original_verified"]), ("exact_quote_location", ["exact_quote_location", "quote_location", "page_number"]),
        ("url_or_path", ["url_or_path", "local_path", "로컬_보관_경로"]), ("title", ["title", "자료명"]),
    ],
    "gate": [
        ("source_id", ["source_id"]), ("claim_id", ["claim_id"]), ("claim_type", ["classification", "분류"]), ("exact_quote_location", ["exact_quote_location", "quote_location", "page_number"]),
        ("source_ids", ["source_ids", "주요_증거"]), ("status", ["=status", "readiness", "상태"]), ("evidence_class", ["evidence_class"]), ("original_verified", ["original_verified"]),
        ("title", ["title", "자료명"]), ("url_or_path", ["url_or_path", "local_path", "로컬_보관_경로"]),
    ],
    "preflight": [
        ("source_id", ["source_id"]), ("title", ["^원본 자료명", "source_title", "=title"]), ("reliability_tier", ["신뢰도", "tier", "reliability"]), ("status", ["=status", "readiness"]),
        ("url_or_path", ["local_path", "로컬_보관_경로", "url_or_path"]), ("claim_id", ["claim_id"]), ("claim_type", ["classification", "분류"]),
        ("exact_quote_location", ["exact_quote_location", "quote_location", "page_number"]), ("source_ids", ["source_ids", "주요_증거"]),
    ],
    "consistency": [
        ("source_id", ["source_id"]), ("title", ["^원본 자료명", "source_title", "=title", "자료명"]), ("status", ["=status", "readiness", "상태"]), ("used_in", ["used_in", "사용"]),
        ("url_or_path", ["url_or_path", "local_path", "로컬_보관_경로"]), ("capture_path", ["capture_path"]), ("local_original_path", ["local_original_path", "original_file_path", "original path"]),
        ("source_record_path", ["source_record_path"]), ("original_path", ["original_path"]), ("use_level", ["use_level"]), ("url_status", ["url_status"]), ("download_status", ["download_status"]),
        ("capture_status", ["capture_status"]), ("url", ["=url", "=official_url"]), ("source_locator", ["source_locator", "quote_location", "exact_quote_location"]),
        ("needs_user_file", ["needs_user_file"]), ("user_file_request_id", ["user_file_request_id"]),
    ],
}


def canonical(header: Column, rules: str) -> Column:
    """The canonical name of a header; one that no rule knows is its lower case with blanks as underscores."""
    text = F.lower(clean_cell(F.coalesce(header, F.lit(""))))

    def named(t: Column) -> Column:
        compact = F.regexp_replace(t, r"\s+", "_")
        test = {"=": lambda m: t == m[1:], "^": lambda m: t.startswith(m[1:])}
        out = compact
        for name, marks in reversed(RULES[rules]):
            hit = F.lit(False)
            for m in marks:
                hit = hit | (test[m[0]](m) if m[0] in test else F.contains(t if " " in m else compact, F.lit(m)))
            out = F.when(hit, name).otherwise(out)
        return out

    return F.transform(F.array(text), named)[0]  # the cleaned header is bound once, not cleaned for every mark


def rename(register: DataFrame, rules: str) -> DataFrame:
    """A register with canonical columns; of columns that share a name the last one stays. Only headers reach the driver."""
    spark, names = register.sparkSession, register.columns
    if not names:
        return register
    found = spark.createDataFrame(list(enumerate(names)), "i int, h string").select("i", canonical(F.col("h"), rules).alias("c")).collect()
    last = {r["c"]: r["i"] for r in sorted(found, key=lambda r: r["i"])}
    plain = register.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{i}").alias(c) for c, i in last.items()])


def list_values(cell: Column) -> Column:
    """A cell that holds several values, parted by commas or semicolons; blanks are left out."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), "[,;]"), strip), lambda v: v != "")


def json_object(text: Column) -> Column:
    """The text if it is a JSON object, else the empty object."""
    good = F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{")
    return F.when(F.coalesce(good, F.lit(False)), text).otherwise("{}")


def first_column_ids(text: Column, pattern: str) -> Column:
    """Distinct ids in the first cell of pipe-table lines, sorted."""
    found = F.regexp_extract_all(text, F.lit(rf"(?m)^\|[ \t`]*({pattern})[ \t`]*\|"), 1)
    return F.array_sort(F.array_distinct(found))


def named_ids(text: Column, heading: str, hint: str) -> Column:
    """Distinct ids in the first column of the pipe table in a named section, sorted.

    The section goes from its heading, numbered or not, to the next one of any level from two. A first cell is no id
    if it is empty, a rule of dashes and colons, has a blank in it, or holds the column's own name ``hint``.
    """
    part = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?ims)^##+[ \t]*(?:\d+\.[ \t]*)?{heading}[^\n]*\n(.*?)(?=^##|\z)", 1)
    lines = F.regexp_extract_all(part, F.lit(r"(?m)^[ \t]*\|([^|\n]*)\|(?:[^\n]*\|)?[ \t]*$"), 1)
    cells = F.transform(lines, lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "^`+|`+$", ""))
    ok = lambda c: (c != "") & ~c.rlike("^[-:]+$") & ~c.contains(" ") & ~F.contains(F.lower(c), F.lit(hint))
    return F.array_sort(F.array_distinct(F.filter(cells, ok)))


def merged(*layers: str | dict | None) -> dict:
    """Configuration layers, later ones first in rank, nested objects merged; a layer that is no JSON object counts as empty."""
    out: dict = {}
    for layer in layers:
        if isinstance(layer, str):
            try:
                layer = json.loads(re.sub("^﻿", "", layer))
            except json.JSONDecodeError:
                layer = None
        for k, v in (layer if isinstance(layer, dict) else {}).items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def at(config: dict, path: str, default=None):
    """The value at a dotted path of nested objects, else the default."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def layered(df: DataFrame, key: str, layers: list[str], levels: int = 6) -> DataFrame:
    """(key, path, value) of the settings that JSON columns give together, later columns over earlier ones, nested objects merged.

    A value counts if no later layer has anything at its path or a value, not an object, above it: so a value
    replaces an object and an object a value, as in ``merged``. Paths are dotted names, lists are values;
    texts come out bare, other values as JSON, and an object without names as {}. A layer that is no JSON object counts as
    empty. Objects nested deeper than ``levels`` are values; names hold no dots. Keys are distinct.
    """
    spark = df.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.try_parse_json(F.regexp_replace(json_object(F.col(c)), "^\ufeff", "")).alias("v")) for i, c in enumerate(layers)]))
    now = df.select(F.col(key).alias("k"), each.alias("e")).select("k", "e.rank", F.lit("").alias("path"), "e.v")
    entries = None
    for level in range(levels):
        below = "SELECT k, rank, concat_ws('.', nullif(path, ''), e.key) AS path, e.value AS v FROM {t}, LATERAL variant_explode(v) e"
        now = spark.sql(below, t=now).withColumn("object", F.schema_of_variant("v").startswith("OBJECT<") & (F.schema_of_variant("v") != "OBJECT<>") & F.lit(level < levels - 1))
        entry = now.select("k", "rank", "path", "object", F.when(~F.col("object"), F.coalesce(F.col("v").cast("string"), F.lit("null"))).alias("value"))
        entries = entry if entries is None else entries.unionByName(entry)
        now = now.filter("object").select("k", "rank", "path", "v")
    entries = kept(entries, "settings")
    plain, empty = entries.filter("not object and value <> '{}'"), entries.filter("value = '{}'")
    last = entries.groupBy("k", "path").agg(F.max("rank").alias("_last"))
    flat = plain.groupBy("k", F.col("path").alias("_above")).agg(F.max("rank").alias("_flat"))
    own = plain.join(last, ["k", "path"]).filter("rank = _last").select("k", "rank", "path", "value")
    own = own.unionByName(empty.groupBy("k", "path").agg(F.max("rank").alias("rank"), F.max("value").alias("value")))
    parts = F.split("path", r"\.")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("_above")
    hidden = own.select("k", "path", "value", "rank", above).join(flat, ["k", "_above"]).filter("_flat > rank").select("k", "path", "value").distinct()
    left = own.join(hidden, ["k", "path", "value"], "left_anti").select("k", "path", "value")
    # an object without names stands for itself where nothing lies below it
    filled = left.select("k", "path", above).filter("_above <> path").select("k", F.col("_above").alias("path"), F.lit("{}").alias("value")).distinct()
    return left.join(filled, ["k", "path", "value"], "left_anti").select(F.col("k").alias(key), "path", "value")
