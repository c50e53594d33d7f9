import pytest
from pyspark.sql import functions as F

from strata.sources import headers as H


@pytest.mark.parametrize(("rules", "header", "want"), [
    ("integrity", "Source IDs", "source_id"), ("integrity", "**원본 자료명** (x)", "title"), ("integrity", "source_readiness_status", "status"), ("integrity", "Type", "claim_type"), ("integrity", "Some  Note", "some_note"),
    ("quality", "자료명", "title"), ("quality", "page_number", "exact_quote_location"), ("gate", "주요 증거", "source_ids"), ("gate", "상태", "status"), ("preflight", "상태", "상태"),
    ("preflight", "tier 1", "reliability_tier"), ("consistency", "URL", "url"), ("consistency", "original_path", "original_path"), ("consistency", "Original Path", "local_original_path"), ("consistency", None, "")])
def test_first_rule_decides(spark, rules, header, want):
    assert spark.createDataFrame([(header,)], "h string").select(H.canonical(F.col("h"), rules)).collect()[0][0] == want


def test_rename_keeps_the_last(spark):
    df = spark.createDataFrame([("a", "b", "c")], ["source id", "Note", "source_ids"])
    got = H.rename(df, "gate")
    assert sorted(got.columns) == ["note", "source_id"] and got.collect()[0].asDict() == {"source_id": "c", "note": "b"}


def test_values_objects_and_layers(spark):
    df = spark.createDataFrame([("a; b,,c", '{"x": 1}'), (None, "[1]"), ("", "{bad"), ("z", None)], "v string, j string")
    rows = df.select(H.list_values(F.col("v")).alias("v"), H.json_object(F.col("j")).alias("j")).collect()
    assert [r["v"] for r in rows] == [["a", "b", "c"], [], [], ["z"]] and [r["j"] for r in rows] == ['{"x": 1}', "{}", "{}", "{}"]
    t = spark.createDataFrame([("| SRC-2 | x |\n|`SRC-1`| y |\n| SRC-2 | z |\n",)], "t string")
    assert t.select(H.first_column_ids(F.col("t"), r"SRC-\d+")).collect()[0][0] == ["SRC-1", "SRC-2"]
    assert H.merged({"a": {"b": 1, "c": 2}, "d": 0}, '{"a": {"c": 3}}', "not json", "[]", None) == {"a": {"b": 1, "c": 3}, "d": 0}


def test_layers_are_those_merged_in_memory(spark):
    import json
    import random

    rng = random.Random(5)

    def made(depth):
        return {rng.choice("abc"): made(depth - 1) if depth and rng.random() < 0.6 else rng.choice([1, "t", None, True, [1, {"x": 2}], {}]) for _ in range(rng.randrange(4))}

    def flat(value, path=()):
        if isinstance(value, dict) and value:
            return {k: v for n, x in value.items() for k, v in flat(x, (*path, n)).items()}
        return {".".join(path): value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))} if path else {}

    odd = [None, "", "[1]", "{bad", "7"]
    rows = [(i, *[json.dumps(made(3)) if rng.random() < 0.85 else rng.choice(odd) for _ in range(3)]) for i in range(150)]
    got: dict[int, dict] = {}
    for r in H.layered(spark.createDataFrame(rows, "i int, a string, b string, c string").repartition(3), "i", ["a", "b", "c"]).collect():
        got.setdefault(r["i"], {})[r["path"]] = r["value"]
    for i, *layers in rows:
        assert got.get(i, {}) == flat(H.merged(*[x or "" for x in layers])), layers
