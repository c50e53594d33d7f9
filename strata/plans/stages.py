"""Queries on the steps of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import steps as S
from strata.plans.registry import query, read

_FACTS = {
    "prd": 0, "toc": 1, "toc_reviews": 2, "source_plans": 3, "sources": 4, "claims": 4, "registers_agree": 5, "skeletons": 6, "workpacks": 7, "preflight": 8, "chapters": 9, "reviewed": 10, "enhanced": 11,
    "visual_rows": 12, "data_files": 13, "visual_pass": 14, "chapter0": 15, "summaries": 16, "style_pass": 17, "cover": 18, "report": 19, "manifest": 20, "assembled_after_style": 21, "factory_errors": 22,
}
_FLAGS = {"registers_agree", "preflight", "reviewed", "enhanced", "visual_pass", "chapter0", "style_pass", "cover", "report", "manifest", "assembled_after_style"}


def _fact(name: str, i: int) -> str:
    lacks = f"(o_orderkey % 24 = {i} OR o_orderkey % 37 = {i})"
    if name in _FLAGS:
        return f"CASE WHEN o_orderkey % 41 = {i} THEN NULL ELSE NOT {lacks} END AS {name}"
    return f"CASE WHEN {lacks} THEN {3 if name == 'factory_errors' else 0} ELSE {0 if name == 'factory_errors' else 'o_orderkey % 3 + 1'} END AS {name}"


_FACT_ROWS = [_fact(n, i) for n, i in _FACTS.items()]


@query(f"""WITH f AS (SELECT o_orderkey, {", ".join(_FACT_ROWS)} FROM orders),
p AS (SELECT o_orderkey, coalesce(nullif(list_position([{", ".join(f"coalesce({ok}, false)" for _, _, ok in S.STEPS)}], false), 0), {len(S.STEPS) + 1}) AS p FROM f)
SELECT o_orderkey, ([{", ".join(f"'{s}'" for s, _, _ in S.STEPS)}, '{S.READY[0]}'])[p] AS state, ([{", ".join(f"'{a}'" for _, a, _ in S.STEPS)}, '{S.READY[1]}'])[p] AS action, (p - 1)::BIGINT AS done FROM p""")
def next_step(spark, sf_dir):
    facts = read(spark, sf_dir, "orders").selectExpr("o_orderkey", *_FACT_ROWS)
    return S.next_step(facts, "o_orderkey")


_REQUESTS = "SELECT DISTINCT conv_id, CASE conv_id % 7 WHEN 0 THEN 'chapter' WHEN 1 THEN 'visual' WHEN 2 THEN 'assemble' WHEN 3 THEN 'review' WHEN 4 THEN 'source' WHEN 5 THEN 'interview' ELSE 'none' END AS stage, CASE conv_id % 3 WHEN 0 THEN 'ch02' WHEN 1 THEN '' END AS chapter FROM {t}"
_HAVE = "SELECT conv_id, CASE turn % 6 WHEN 0 THEN 'reports/report_claim_register.md' WHEN 1 THEN 'reports/chapter_workpacks/ch0' || (conv_id % 3) || '_workpack.md' WHEN 2 THEN 'data_sources/visual_plan.csv' WHEN 3 THEN 'reports/cover.data.json' WHEN 4 THEN 'source_index/source_master_index.md' ELSE 'reports/chapters/ch01.html' END AS path FROM {t}"


@query(f"""WITH r AS ({_REQUESTS.format(t="conversations")}), h AS (SELECT DISTINCT * FROM ({_HAVE.format(t="conversations")})),
d AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{p}', {r})" for s, p, r in S.STAGE_FILES)}) x(stage, path, required)),
n AS (SELECT conv_id, replace(path, '{{chapter}}', coalesce(nullif(chapter, ''), 'ch01')) AS path, bool_or(required) AS required FROM r JOIN d USING (stage) GROUP BY ALL)
SELECT n.conv_id, n.path, required, h.conv_id IS NOT NULL AS present FROM n LEFT JOIN h ON h.conv_id = n.conv_id AND h.path = n.path""")
def stage_files(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    asked = c.select("conv_id", *[F.expr(e).alias(n) for n, e in (("stage", _between(_REQUESTS, "conv_id, ", " AS stage")), ("chapter", _between(_REQUESTS, "AS stage, ", " AS chapter")))]).distinct()
    return S.stage_files(asked, c.select("conv_id", F.expr(_between(_HAVE, "conv_id, ", " AS path")).alias("path")), "conv_id")


def _between(sql: str, a: str, b: str) -> str:
    return sql.split(a, 1)[1].split(b, 1)[0]


_LF = "chr(10)"
_HEAD = f"CASE doc_id % 6 WHEN 0 THEN 'Reader decision  ' || {_LF} || {_LF} || ' Which   roadmap ?' WHEN 1 THEN 'CORE QUESTION' || {_LF} || '   ' || {_LF} || '# Options to compare' WHEN 2 THEN '## 정산 흐름과 비용' WHEN 3 THEN 'risk 리스크 승인' WHEN 4 THEN '' ELSE 'revenue' END"
_TEXT = f"{_HEAD} || {_LF} || CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(text, '') END"
_CHAPTER = "'ch' || CASE WHEN doc_id % 10 = 0 THEN '10' ELSE '0' || (doc_id % 10) END"
_PLACE = "doc_id % 120"
_PLANNED = "CASE doc_id % 4 WHEN 0 THEN ' VIS-' || {c} || '-' || CASE WHEN doc_id % 120 < 10 THEN '0' ELSE '' END || (doc_id % 120) WHEN 1 THEN '' END"


def _hits(kind: str) -> str:
    return " + ".join(f"contains(lower(t), '{x.lower()}')::INT" for x in S.VISUALS[kind])


@query(rf"""WITH c AS (SELECT doc_id, {_CHAPTER} AS chapter, {_PLACE} AS place, {_TEXT} AS t, {_PLANNED.format(c="(" + _CHAPTER + ")")} AS planned FROM documents),
h AS (SELECT *, [{", ".join(_hits(k) for k in S.VISUALS)}] AS hits FROM c),
k AS (SELECT *, CASE WHEN list_max(hits) = 0 THEN '{S.NO_VISUAL}' ELSE ([{", ".join(f"'{k}'" for k in S.VISUALS)}])[list_position(hits, list_max(hits))] END AS kind FROM h),
v AS (SELECT *, printf('vis-%s-%02d', chapter, place) AS visual_id FROM k)
SELECT doc_id, visual_id, kind, coalesce({", ".join(f"substr(nullif(trim(regexp_replace(regexp_extract(t, '{p}', 1), '[ \t\n\r\f\v]+', ' ', 'g')), ''), 1, 80)" for p in S.TITLES)}, chapter || ' ' || replace(kind, '_', ' ')) AS title
FROM v WHERE lower(trim(coalesce(planned, ''))) <> lower(visual_id)""")
def suggested_visuals(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr("doc_id", f"{_CHAPTER} AS chapter", f"{_PLACE} AS place", f"{_TEXT} AS text", f"{_PLANNED.format(c='(' + _CHAPTER + ')')} AS visual_id")
    return S.suggested_visuals(d, d, "doc_id")


_PLAN = """SELECT doc_id, CASE i WHEN 2 THEN '' ELSE 'v' || i END AS visual_id, CASE (doc_id + i) % 3 WHEN 0 THEN substr(text, 3, 12) WHEN 1 THEN 'no such title ' || i END AS title,
CASE (doc_id + i) % 4 WHEN 0 THEN 'data/' || i || '.csv' ELSE '' END AS data_file, CASE (doc_id + i) % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'YES' WHEN 2 THEN 'required' WHEN 3 THEN '1' END AS required,
CASE (doc_id + i) % 7 WHEN 0 THEN 'Dropped' ELSE 'planned' END AS status, CASE (doc_id + i) % 6 WHEN 0 THEN 'Bar_Chart' WHEN 1 THEN '흐름도' ELSE 'table' END AS kind FROM {t}"""
_RAW = "'<p>' || coalesce(text, '') || '</p>' || CASE WHEN doc_id % 2 = 0 THEN 'data/1.csv data/3.csv' ELSE '' END"


@query(rf"""WITH r AS (SELECT doc_id, text AS visible, {_RAW} AS raw, doc_id % 3 AS figures FROM documents), p AS ({_PLAN.format(t="documents, range(1, 5) x(i)")}),
j AS (SELECT p.doc_id, coalesce(lower(required), '') IN ('yes', 'y', 'true', '1', 'required') AS need, coalesce(nullif(visual_id, ''), nullif(title, ''), '(unnamed visual)') AS name,
lower(status) NOT IN ('dropped', 'cancelled', 'not_applicable') AND NOT (coalesce(title, '') <> '' AND contains(coalesce(visible, ''), title)) AND NOT (data_file <> '' AND contains(raw, data_file)) AS lost,
regexp_matches(kind, '{S.CHART_LIKE}') AND figures = 0 AS chart FROM p JOIN r USING (doc_id))
SELECT doc_id, count(*) FILTER (need) AS n_required, count(*) FILTER (need AND coalesce(lost, true)) AS n_missing, coalesce(array_to_string(list_sort(list(name) FILTER (need AND coalesce(lost, true)))[1:8], ' | '), '') AS missing, bool_or(need AND chart) AS chart_missing FROM j GROUP BY doc_id""")
def missing_visuals(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    reports = d.selectExpr("doc_id", "text AS visible", f"{_RAW} AS raw", "doc_id % 3 AS figures")
    numbered = d.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i"))
    return S.missing_visuals(reports, spark.sql(_PLAN.format(t="{numbered}"), numbered=numbered), "doc_id")


_WORDS = "CASE p_partkey % 8 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'off' WHEN 2 THEN 'maybe' WHEN 3 THEN '12' WHEN 4 THEN ' -7' WHEN 5 THEN '1.5' WHEN 6 THEN '' END"


def _member(v: str, words: tuple[str, ...]) -> str:
    return f"{v} IN ({', '.join(repr(w) for w in words)})"


@query(f"""WITH w AS (SELECT p_partkey, trim({_WORDS}) AS v, p_size FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(v, '[+-]?[0-9]{{1,18}}') THEN try_cast(v AS BIGINT) ELSE p_size END::BIGINT AS least, CASE WHEN {_member("lower(v)", S.YES)} THEN true WHEN {_member("lower(v)", S.NO)} THEN false ELSE p_size > 25 END AS needed FROM w""")
def resolved_settings(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.expr(_WORDS).alias("v"), F.col("p_size").cast("long").alias("n"))
    return p.select("p_partkey", S.as_number(F.col("v"), F.col("n")).alias("least"), S.as_flag(F.col("v"), F.col("n") > 25).alias("needed"))


_EXPORTS = """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' ELSE 'hwpx' END AS kind, s_suppkey % 12 = 0 AS locked, s_suppkey % 5 <> 0 AS valid, s_suppkey % 7 <> 0 AS has_document,
s_suppkey % 3 = 0 AS has_styles, s_suppkey % 6 <> 2 AS mimetype, s_suppkey % 10 <> 3 AS contract, s_suppkey % 2 = 0 OR s_suppkey % 9 = 0 AS strict, s_suppkey % 3 AS checks, s_suppkey % 2 AS renders FROM {t}"""


@query(f"WITH e AS ({_EXPORTS.format(t='supplier')}) " + " UNION ALL ".join(f"SELECT s_suppkey, '{s}' AS severity, '{r}' AS rule FROM e WHERE {c}" for s, r, c in S.EXPORT_RULES))
def export_findings(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier")
    return S.export_findings(spark.sql(_EXPORTS.format(t="{supplier}"), supplier=supplier), "s_suppkey")
