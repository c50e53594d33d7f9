"""Queries on published tables, scanned folders and mined rules."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F

from strata.operators import mining, publish, sinks
from strata.plans.registry import query, read
from strata.sources import filetree

# A register published twice, between and after them a write that fails


def _published(spark, sf_dir) -> str:
    root = f"{sinks.shared_folder(spark)}/register-{uuid.uuid4().hex}"
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    broken = c.withColumn("c_name", F.when(F.col("c_custkey") % 10 == 7, F.raise_error(F.lit("a row that cannot be written"))).otherwise(F.col("c_name")))
    renamed = c.withColumn("c_name", F.when(F.col("c_nationkey") < 5, F.upper("c_name")).otherwise(F.col("c_name")))
    for df in (c, broken, renamed.filter("c_custkey % 3 <> 1"), renamed.filter("c_custkey % 3 <> 1").repartition(3), broken):
        with contextlib.suppress(Exception):
            publish.publish(df, root)
    publish.prune(spark, root)
    return root


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey FROM customer WHERE c_custkey % 3 <> 1")
def published_rows(spark, sf_dir):
    return publish.current(spark, _published(spark, sf_dir))


@query("""WITH n AS (SELECT count(*) AS a, count(*) FILTER (c_custkey % 3 <> 1) AS b FROM customer)
SELECT unnest([1, 2, 3, 4, 5]) AS event, unnest(['published', 'failed', 'published', 'published', 'failed']) AS state, unnest([0, a, a, b, b]) AS rows_before, unnest([a, a, b, b, b]) AS rows_after, unnest([true, false, true, false, false]) AS changed FROM n""")
def publish_events(spark, sf_dir):
    return publish.events(spark, _published(spark, sf_dir)).select("event", "state", "rows_before", "rows_after", "changed")


# A folder of texts, one for each supplier, and what patterns name in it

_PATTERNS = [("report", "kind=a/n=[0-4]*/*.txt", True), ("chapter", "kind=*/n=1?/*.txt", False), ("rest", "**/*.txt", False), ("cover", "reports/cover.json", True), ("extra", "kind=z/*", False), ("style", "kind=[!abc]/**/*.css", True)]


@query("""WITH s AS (SELECT s_suppkey AS n, (['a', 'b', 'c'])[s_suppkey % 3 + 1] AS kind FROM supplier),
f AS (SELECT CASE WHEN kind = 'a' AND regexp_matches(n::VARCHAR, '^[0-4]') THEN 'report' WHEN regexp_full_match(n::VARCHAR, '1.') THEN 'chapter' ELSE 'rest' END AS role, 'kind=' || kind || '/n=' || n AS place FROM s)
SELECT role, place, role = 'report' AS required, true AS present FROM f UNION ALL VALUES ('cover', 'reports', true, false), ('style', 'kind=[!abc]/**', true, false)""")
def scanned_files(spark, sf_dir):
    root = f"{sinks.shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    s = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("value"), F.get(F.array(*map(F.lit, "abc")), (F.col("s_suppkey") % 3).cast("int")).alias("kind"), F.col("s_suppkey").alias("n"))
    filetree.written(s, root, ["kind", "n"], "value")
    found = filetree.named(filetree.listing(spark, root), _PATTERNS)
    return found.select("role", F.regexp_replace("path", "/[^/]*$", "").alias("place"), "required", "present")


# Mined rules: a supplier is a pair of documents, its lines give the counts of their profiles

_PATHS = [("source", p) for p in sorted({r[2] for r in mining.RULES})] + [("target", p) for p in sorted({r[3] for r in mining.RULES})]
_PROFILE = "SELECT l_suppkey AS pair, l_partkey % {m} AS i, sum(CASE WHEN l_partkey % 3 = 0 THEN l_linenumber ELSE 1 END)::BIGINT AS value FROM lineitem GROUP BY ALL"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


@query(f"""WITH f AS ({_PROFILE.format(m=len(_PATHS) + 4)}), x(i, side, path) AS (VALUES {_values([(i, *p) for i, p in enumerate(_PATHS)])}), p AS (SELECT pair, side, path, value FROM f JOIN x USING (i)),
r(rule_id, priority, a, b, made_by) AS (VALUES {_values(mining.RULES)}), s AS (SELECT DISTINCT l_suppkey AS pair, CASE l_suppkey % 3 WHEN 0 THEN 'hancom' WHEN 1 THEN 'portable' END AS producer FROM lineitem),
o AS (SELECT s.pair, rule_id, priority, made_by IS NULL OR made_by = coalesce(producer, '') AS here, coalesce(u.value, CASE WHEN regexp_matches(a, '(layout_control_child_counts|section_ctrl_child_counts)[.][^.]+$') THEN 0 END) AS a, coalesce(v.value, CASE WHEN regexp_matches(b, '(layout_control_child_counts|section_ctrl_child_counts)[.][^.]+$') THEN 0 END) AS b
FROM s CROSS JOIN r LEFT JOIN p u ON u.pair = s.pair AND u.side = 'source' AND u.path = r.a LEFT JOIN p v ON v.pair = s.pair AND v.side = 'target' AND v.path = r.b),
c AS (SELECT *, CASE WHEN NOT here THEN 'not_applicable' WHEN a IS NULL OR b IS NULL THEN 'missing_signal' WHEN a = b THEN 'exact' WHEN a > 0 AND b > 0 THEN CASE WHEN abs(a - b) <= greatest(2, round_even(greatest(a, b) * 0.05::DOUBLE, 0)) THEN 'close' ELSE 'both_present' END WHEN a > 0 THEN 'source_only' ELSE 'target_only' END AS relation FROM o),
g AS (SELECT rule_id, priority, count(*) FILTER (here AND a IS NOT NULL AND b IS NOT NULL) AS compared, {", ".join(f"count(*) FILTER (relation = '{k}') AS {n}" for k, n in (("exact", "exact"), ("close", "close"), ("both_present", "both_present"), ("source_only", "source_only"), ("target_only", "target_only"), ("missing_signal", "missing"), ("not_applicable", "not_applicable")))},
coalesce(array_to_string((list(b - a ORDER BY pair) FILTER (here AND a IS NOT NULL AND b IS NOT NULL))[1:8], ','), '') AS deltas FROM c GROUP BY ALL), h AS (SELECT *, coalesce(round_even((exact + close * 0.7::DOUBLE + both_present * 0.4::DOUBLE) / nullif(compared, 0), 4), 0) AS score FROM g)
SELECT *, CASE WHEN score >= 0.95 THEN 'high_confidence' WHEN score >= 0.75 THEN 'medium_confidence' WHEN score >= 0.45 THEN 'weak_signal' ELSE 'exploratory' END AS band FROM h""")
def rule_report(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    n = F.when(F.col("l_partkey") % 3 == 0, F.col("l_linenumber")).otherwise(1)
    place = lambda k: F.get(F.array(*[F.lit(p[k]) for p in _PATHS]), F.col("i").cast("int"))
    f = lines.groupBy(F.col("l_suppkey").alias("pair"), (F.col("l_partkey") % (len(_PATHS) + 4)).alias("i")).agg(F.sum(n).alias("value"))
    profiles = f.select("pair", place(0).alias("side"), place(1).alias("path"), "value")
    pairs = lines.select(F.col("l_suppkey").alias("pair")).distinct().withColumn("producer", F.when(F.col("pair") % 3 == 0, "hancom").when(F.col("pair") % 3 == 1, "portable"))
    return mining.report(mining.observations(pairs, profiles))


# Tables of texts replaced in the session's catalogue, and registers begun where there is none


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, lower(s_name) AS s_name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_nationkey::VARCHAR END AS nation FROM supplier WHERE s_suppkey % 2 = 0")
def replaced_table(spark, sf_dir):
    name = f"strata_{uuid.uuid4().hex}"
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    sinks.replace_table(s, name, f"{sinks.shared_folder(spark)}/{name}-a")
    nation = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey"))
    after = read(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select("s_suppkey", F.lower("s_name").alias("s_name"), nation.alias("nation"))
    sinks.replace_table(after, name, f"{sinks.shared_folder(spark)}/{name}-b")
    return spark.table(name)


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, NULL AS note FROM customer UNION ALL SELECT 'n' || n_nationkey, NULL, n_name FROM nation")
def begun_register(spark, sf_dir):
    register = sinks.begun(spark, None, ["id", "name", "note"])
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("note"), F.lit(1).alias("other"))
    return sinks.begun(spark, sinks.appended(sinks.appended(register, c), n), ["id"])
