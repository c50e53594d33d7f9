"""Queries that write registers, logs and texts made of the supplied tables, and read them back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import registers as R
from strata.operators import sinks
from strata.plans.registry import query, read
from strata.sources import containers, headers
from strata.sources import registers as S


def _path(spark) -> str:
    return f"{sinks.shared_folder(spark)}/strata-formats/{uuid.uuid4().hex}"


@query("""SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, trim(coalesce(replace(text, '"', '""'), ''), E' \\t\\n\\r\\f\\v') AS text, '' AS missing FROM conversations""")
def csv_register(spark, sf_dir):
    """A register written as CSV (fixed fields, null as empty) and read as stripped strings."""
    path = _path(spark)
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace("text", F.lit('"'), F.lit('""')).alias("text"), F.lit(None).cast("string").alias("missing"))
    S.write_csv(c, path, ["conv_id", "turn", "text", "missing"])
    return S.read_csv(spark, path)


_SHEET = """SELECT c_nationkey AS path, '# sheet' || chr(10) || '| id | name |' || chr(10) || '|----|:---|' || chr(10) || string_agg('| ' || c_custkey || ' | ' || c_name || CASE WHEN c_custkey % 7 = 0 THEN ' | x |' ELSE ' |' END, chr(10) ORDER BY c_custkey)
|| chr(10) || '- **Status**: open' || chr(10) || '- `status`: ' || count(*) || chr(10) || '* **Owner** : ' || min(c_name) || chr(10) || '## 2. Exact Quotes' || chr(10) || '- quote ' || max(c_custkey) || chr(10) || '## 3. End' || chr(10) AS text FROM customer GROUP BY c_nationkey"""


def _sheets(spark, sf_dir):
    k, n = F.col("c_custkey"), F.lit("\n")
    row = F.concat(F.lit("| "), k.cast("string"), F.lit(" | "), "c_name", F.when(k % 7 == 0, " | x |").otherwise(" |"))
    g = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("path")).agg(F.array_sort(F.collect_list(F.struct(k, row.alias("r")))).alias("rows"), F.count("*").alias("n"), F.min("c_name").alias("least"), F.max(k).alias("most"))
    text = F.concat(F.lit("# sheet\n| id | name |\n|----|:---|\n"), F.array_join(F.transform("rows", lambda r: r["r"]), "\n"), F.lit("\n- **Status**: open\n- `status`: "), F.col("n").cast("string"), F.lit("\n* **Owner** : "), "least", F.lit("\n## 2. Exact Quotes\n- quote "), F.col("most").cast("string"), F.lit("\n## 3. End"), n)
    return g.select("path", text.alias("text"))


@query("SELECT c_nationkey AS path, c_custkey::VARCHAR AS id, c_name AS name FROM customer WHERE c_custkey % 7 <> 0")
def markdown_table(spark, sf_dir):
    rows = S.table_rows(_sheets(spark, sf_dir))
    cells = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["name"], c["value"])))
    return rows.select("path", cells["id"].alias("id"), cells["name"].alias("name"))


@query("SELECT c_nationkey AS path, unnest(['status', 'owner']) AS name, unnest([count(*)::VARCHAR, min(c_name)]) AS value FROM customer GROUP BY c_nationkey")
def markdown_bullets(spark, sf_dir):
    return S.bullets(_sheets(spark, sf_dir))


@query("SELECT c_nationkey AS path, '- quote ' || max(c_custkey) AS quotes FROM customer GROUP BY c_nationkey")
def markdown_section(spark, sf_dir):
    return _sheets(spark, sf_dir).select("path", F.trim(S.section(F.col("text"), "Exact Quotes")).alias("quotes"))


@query("SELECT c_nationkey AS path, array_to_string(list_sort(list(c_custkey::VARCHAR)), ',') AS ids FROM customer GROUP BY c_nationkey")
def markdown_ids(spark, sf_dir):
    return _sheets(spark, sf_dir).select("path", F.array_join(headers.first_column_ids(F.col("text"), "[0-9]+"), ",").alias("ids"))


#: Every mark of the five rule lists stands in the headers of some parts, among words of the part's name.
_MARKS = {k: [m.lstrip("=^") for _, marks in rules for m in marks] for k, rules in headers.RULES.items()}


def _header(rules: str) -> str:
    marks = _MARKS[rules]
    pick = "CASE p_partkey % {} ".format(len(marks) + 2) + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(marks)) + " ELSE 'note' END"
    return f"CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' **' ELSE split_part(p_name, ' ', 1) || '  ' END || CASE WHEN p_partkey % 5 = 0 THEN upper({pick}) WHEN p_partkey % 5 = 1 THEN replace({pick}, '_', ' ') ELSE {pick} END || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '` ' ELSE ' (' || p_brand || ')' END"


def _rule_sql(rules: str) -> str:
    def hit(m: str) -> str:
        return f"t = '{m[1:]}'" if m[0] == "=" else f"starts_with(t, '{m[1:]}')" if m[0] == "^" else f"contains({'t' if ' ' in m else 'c'}, '{m}')"

    return "CASE " + " ".join(f"WHEN {' OR '.join(map(hit, marks))} THEN '{name}'" for name, marks in headers.RULES[rules]) + " ELSE c END"


@query(
    "WITH h AS (" + " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS rules, {_header(k)} AS header FROM part" for k in headers.RULES)
    + r"), t AS (SELECT *, lower(regexp_replace(regexp_replace(trim(header), '^`+|`+$', '', 'g'), '^\*+|\*+$', '', 'g')) AS u, trim(u) AS t, regexp_replace(trim(u), '\s+', '_', 'g') AS c FROM h) SELECT p_partkey, rules, CASE rules "
    + " ".join(f"WHEN '{k}' THEN {_rule_sql(k)}" for k in headers.RULES) + " END AS name FROM t"
)
def header_names(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    made = sinks.kept(reduce(lambda a, b: a.unionByName(b), [part.select("p_partkey", F.lit(k).alias("rules"), F.expr(_header(k)).alias("header")) for k in headers.RULES]), "headers")
    lists = [made.filter(F.col("rules") == k).select("p_partkey", "rules", headers.canonical(F.col("header"), k).alias("name")) for k in headers.RULES]
    return reduce(lambda a, b: a.unionByName(b), lists)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{}' WHEN event_id % 4 = 1 THEN '{}' ELSE props END AS body FROM events")
def json_objects(spark, sf_dir):
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", headers.json_object(F.when(i % 4 == 0, "not json {").when(i % 4 == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))).alias("body"))


@query("SELECT event_id, event_type, event_id % 2 = 1 AS second FROM events")
def event_log(spark, sf_dir):
    """A log of JSON lines, appended to twice, with lines that do not parse; its CSV mirror holds the same rows."""
    path, e = _path(spark), read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 2 == 1).alias("second"))
    for rest in (0, 1):
        S.append_events(e.filter(F.col("event_id") % 2 == rest), path, mirror=path + "-csv")
    spark.createDataFrame([("not json",), ("",)], "value string").write.mode("append").text(path)
    log = S.read_events(spark, path, "event_id long, event_type string, second boolean")
    mirror = S.read_csv(spark, path + "-csv").select(F.col("event_id").cast("long").alias("event_id"))
    return log.join(mirror, "event_id", "left_semi")


@query("SELECT count(DISTINCT text) AS contents, count(DISTINCT text) FILTER (item_id % 2 = 1 AND text NOT IN (SELECT text FROM benchmark WHERE item_id % 2 = 0 AND text IS NOT NULL)) AS fresh FROM benchmark WHERE text IS NOT NULL")
def files_by_hash(spark, sf_dir):
    """A file per text of the benchmark, found by hash; those whose hash the inventory lacks are new."""
    path = _path(spark)
    d = read(spark, sf_dir, "benchmark").filter("text is not null").select((F.col("item_id") % 2).alias("half"), "item_id", "text")
    d.repartition("item_id").write.partitionBy("half", "item_id").option("lineSep", "\x01").text(path)
    found = S.files_by_hash(spark, path)
    known = found.filter(F.col("path").contains("half=0"))
    fresh = S.new_files(found.filter(F.col("path").contains("half=1")), known)
    return found.agg(F.count_distinct("sha256").alias("contents")).join(fresh.agg(F.count("*").alias("fresh")))  # one row each


_LAYERS = [
    "'{\"limits\": {\"rows\": ' || s_suppkey || ', \"preview\": 1200, \"deep\": {\"x\": 1}}, \"lang\": \"ko\"}'",
    "CASE s_suppkey % 5 WHEN 0 THEN 'not json' WHEN 1 THEN '[1]' WHEN 2 THEN '{\"limits\": 7}' WHEN 3 THEN '{\"lang\": {\"a\": \"' || s_name || '\"}}' END",
    "CASE s_suppkey % 4 WHEN 0 THEN '{\"limits\": {\"rows\": ' || s_nationkey || '}, \"tiers\": [1, \"b\"]}' WHEN 1 THEN '{\"limits\": {\"deep\": {\"y\": true}}}' WHEN 2 THEN '{}' ELSE '{\"lang\": \"en\"}' END",
]
_PATHS = {"limits": "limits", "rows": "limits.rows", "preview": "limits.preview", "x": "limits.deep.x", "y": "limits.deep.y", "lang": "lang", "lang_a": "lang.a", "tiers": "tiers"}


@query(
    "WITH l AS (SELECT s_suppkey, " + ", ".join(f"CASE WHEN json_valid({x}) AND json_type({x}) = 'OBJECT' THEN {x} ELSE '{{}}' END AS l{i}" for i, x in enumerate(_LAYERS)) + " FROM supplier), m AS (SELECT s_suppkey, json_merge_patch(json_merge_patch(l0::JSON, l1::JSON), l2::JSON) AS m FROM l) SELECT s_suppkey, "
    + ", ".join(f"CASE WHEN json_type(m, '$.{p}') <> 'OBJECT' THEN json_extract_string(m, '$.{p}') END AS {n}" for n, p in _PATHS.items()) + " FROM m"
)
def configured(spark, sf_dir):
    layers = read(spark, sf_dir, "supplier").select("s_suppkey", *[F.expr(x).alias(f"l{i}") for i, x in enumerate(_LAYERS)])
    rows = headers.layered(layers, "s_suppkey", ["l0", "l1", "l2"])
    return rows.groupBy("s_suppkey").agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(n) for n, p in _PATHS.items()])


@query(r"""SELECT p_partkey, regexp_replace(lower(p_name), '[ _-]+', '', 'g') AS folded, regexp_replace(regexp_replace(lower(p_name), '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60] AS slug, sha256(p_name)[1:24] AS ref,
'**' || p_name || '` x``' AS cell, CASE WHEN p_partkey * 97 < 16384 THEN 'under_16k' WHEN p_partkey * 97 < 131072 THEN 'under_128k' WHEN p_partkey * 97 < 1048576 THEN 'under_1m' WHEN p_partkey * 97 < 10485760 THEN 'under_10m' ELSE 'over_10m' END AS size,
p_name || chr(9) || 'b' AS clean FROM part""")
def scalar_keys(spark, sf_dir):
    n = F.col("p_name")
    cell = T.clean_cell(F.concat(F.lit(" `` **"), n, F.lit("` x``** ")))
    return read(spark, sf_dir, "part").select("p_partkey", T.fold_key(n).alias("folded"), T.slug(n).alias("slug"), T.short_ref(n).alias("ref"), cell.alias("cell"), T.size_bucket(F.col("p_partkey") * 97).alias("size"), T.without_controls(F.concat(n, F.lit("\x01\t\x7fb"))).alias("clean"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'zip' WHEN 1 THEN 'pdf' WHEN 2 THEN 'compound' ELSE 'other' END AS kind FROM pages")
def container_kinds(spark, sf_dir):
    i = F.col("page_id")
    head = F.when(i % 4 == 0, F.unhex(F.lit("504B030414000000"))).when(i % 4 == 1, F.unhex(F.lit("255044462D312E37"))).when(i % 4 == 2, F.unhex(F.lit("D0CF11E0A1B11AE1"))).otherwise(F.lit("<html>").cast("binary"))
    return read(spark, sf_dir, "pages").select("page_id", containers.kind(F.concat(head, F.coalesce("html", F.lit("")).cast("binary"))).alias("kind"))


@query("""WITH r AS (SELECT n_nationkey AS k, n_name AS v FROM nation), d AS (SELECT n_nationkey AS k, lower(n_name) AS v FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_regionkey + 100, r_name FROM region)
SELECT coalesce(r.k, d.k) AS k, coalesce(d.v, r.v) AS v, CASE WHEN d.k IS NULL THEN 1 WHEN r.k IS NULL THEN 2 ELSE 2 END AS version, true AS current FROM r FULL JOIN d ON r.k = d.k
UNION ALL SELECT r.k, r.v, 1, false FROM r JOIN d ON r.k = d.k""")
def versioned_snapshots(spark, sf_dir):
    """An upsert that keeps the replaced rows as history and points at the current ones."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    delta = n.filter("k % 2 = 0").withColumn("v", F.lower("v")).union(read(spark, sf_dir, "region").select(F.col("r_regionkey") + 100, "r_name"))
    return R.versioned(n.withColumn("version", F.lit(1)), delta, "k", 2)
