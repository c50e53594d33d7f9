"""Queries on report projects, intake of files and profiles of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import factory, profiles, units
from strata.plans.registry import query, read

# Report projects: a supplier is a project, its key says which files it has and what is wrong with them

_CH1 = "'<p>one ' || p || '</p>' || CASE WHEN p % 11 = 0 THEN '<body class=x>' ELSE '' END || CASE WHEN p % 13 = 0 THEN '<script async src=\"https://cdn/x.js\">' ELSE '' END"
_CH0 = "'<p>summary ' || p || '</p>'"
_CHAPTERS = "reports/chapters/ch"
_HAS1, _HAS0 = "p % 6 <> 5", "p % 6 = 1"
_FILES = [
    ("'report_prd/a.md'", "p % 5 < 3", "'Goal' || chr(10) || '- `document_type_preset`: `' || CASE p % 7 WHEN 0 THEN 'bogus' WHEN 1 THEN 'Undecided' ELSE 'memo' END || '`' || CASE WHEN p % 9 < 6 THEN ' a Full Report' ELSE '' END"),
    ("'report_prd/b.md'", "p % 14 = 0", "'document_type_preset: other.one'"),
    ("'drafts/my_toc_1.md'", "p % 3 <> 0", "CASE WHEN p % 9 = 7 THEN 'FULL REPORT' ELSE 'contents' END"),
    ("'reports/major_skeleton.md'", "p % 4 = 0", "'x'"),
    (f"'{_CHAPTERS}01.html'", _HAS1, _CH1),
    (f"'{_CHAPTERS}00_summary.html'", _HAS0, _CH0),
    ("'reports/chapter_workpacks/ch01_workpack.md'", "p % 10 <> 0", "'w'"),
    ("'reports/chapter_workpacks/ch00_summary_workpack.md'", "p % 10 < 5", "'w'"),
    ("'reports/cover.data.json'", "p % 3 <> 1", "'{\"version\": \" ' || CASE WHEN p % 5 = 0 THEN 'v1' WHEN p % 5 = 1 THEN 'k2' ELSE 'v2' END || '\"}'"),
    ("'reports/current/version_pointer.json'", "p % 2 = 1", "CASE WHEN p % 17 = 0 THEN 'no json' ELSE '{\"version\": \"v2\", \"version_key\": \"k2\"}' END"),
    ("'reports/final.html'", "p % 4 <> 3", f"'<div data-assembled-report=\"true\">' || CASE WHEN p % 9 = 0 THEN '' ELSE {_CH1} || {_CH0} END"),
    ("'reports/old.html'", "p % 8 = 1", "'nothing of it'"),
    (f"'{factory.MANIFEST}'", "p % 5 <> 4", f"'{{\"assembly_mode\": \"' || CASE WHEN p % 8 = 0 THEN 'rewrite' ELSE '{factory.MODE}' END || '\", \"chapter_integrity\": [' || CASE WHEN p % 6 = 2 THEN '' ELSE '{{\"path\": \"{_CHAPTERS}01.html\", \"sha256\": \"' || CASE WHEN p % 7 = 3 THEN 'stale' ELSE {{sha}}({_CH1}{{bits}}) END || '\"}}' END || ']' || CASE p % 4 WHEN 0 THEN ', \"visual_pass_manifest\": \"\"' WHEN 1 THEN ', \"visual_pass_manifest\": \"{factory.VISUAL_PASS}\"' WHEN 2 THEN ', \"visual_pass_manifest\": \"else\"' ELSE '' END || '}}'"),
    (f"'{factory.PLAN}'", "p % 3 <> 2", "'csv'"),
    ("'data_sources/d.CSV'", "p % 5 <> 2", "NULL"),
    (f"'{factory.VISUAL_PASS}'", "p % 6 IN (3, 4)", f"'{{\"body_chapter_integrity\": [{{\"path\": \"{_CHAPTERS}01.html\", \"sha256\": \"' || CASE WHEN p % 7 < 4 THEN {{sha}}({_CH1}{{bits}}) ELSE '' END || '\"}}]}}'"),
    (f"'{factory.VISUAL_NOTE}'", "p % 4 = 1", "'note'"),
]
#: Rows of visual plans: two for most projects that have a plan, and one for a project that has none.
_VISUALS = """SELECT p AS project, i AS place, CASE WHEN p % 5 = 1 AND i = 2 THEN '' ELSE 'v' || i END AS visual_id, CASE WHEN p % 10 = 1 THEN NULL ELSE 'title ' || i END AS title, CASE WHEN p % 4 = 0 THEN '' ELSE 'why' END AS purpose, CASE WHEN p % 6 = i THEN NULL ELSE 'use' END AS decision_use,
CASE WHEN p % 3 = 0 THEN 'take' END AS expected_reader_takeaway, CASE WHEN p % 7 = 2 THEN 'YES' ELSE 'no' END AS required, CASE WHEN p % 2 = i - 1 THEN 'Planned' ELSE 'done' END AS status,
CASE p % 4 WHEN 0 THEN 'data_sources/d.CSV' WHEN 1 THEN 'https://x/y' WHEN 2 THEN 'gone.csv' ELSE '' END AS data_file, CASE WHEN p % 8 = 3 THEN 'S1' END AS source_record, p % 9 AS header FROM {t} WHERE p % 5 <> 3"""
_MARKERS, _PRESETS, _LEGACY = ["full report", "장문"], ["memo", "plan"], ["3", "4", "12", "25", "40"]


def _files_sql(sha: str, bits: str) -> str:
    return " UNION ALL ".join(f"SELECT p AS project, {path} AS path, {text.replace('{sha}', sha).replace('{bits}', bits).replace('{{', '{').replace('}}', '}')} AS text FROM s WHERE {when}" for path, when, text in _FILES)


_GAP_RULES = """SELECT project, true AS gap, 'prd_missing' AS rule, '' AS key FROM f WHERE substantial AND NOT prd UNION ALL SELECT project, true, 'toc_missing', '' FROM f WHERE substantial AND NOT toc UNION ALL SELECT project, true, 'skeleton_missing', '' FROM f WHERE substantial AND NOT skeleton
UNION ALL SELECT project, true, 'workpacks_missing', '' FROM f WHERE chapters AND NOT workpacks UNION ALL SELECT project, true, 'chapters_missing', '' FROM f WHERE substantial AND NOT chapters UNION ALL SELECT project, true, 'cover_missing', '' FROM f WHERE substantial AND NOT cover
UNION ALL SELECT project, true, 'cover_stale', concat_ws('/', cv, pv, pk) FROM f WHERE assembled AND pv <> '' AND cv <> '' AND cv <> pv AND cv <> pk UNION ALL SELECT project, true, 'assembled_without_chapters', '' FROM f WHERE assembled AND NOT chapters
UNION ALL SELECT project, true, 'manifest_missing', '' FROM f WHERE assembled AND m IS NULL UNION ALL SELECT project, true, 'manifest_mode', '' FROM f WHERE assembled AND mode <> 'concatenate_only_no_rewrite' UNION ALL SELECT project, true, 'integrity_missing', '' FROM f WHERE assembled AND hashes = 0
UNION ALL SELECT project, true, 'plan_missing', '' FROM f WHERE substantial AND NOT plan UNION ALL SELECT project, true, 'columns_missing', 'chapter, decision_use, purpose, status, visual_id, visual_type' FROM f WHERE plan AND NOT planned
UNION ALL SELECT project, true, 'data_missing', '' FROM f WHERE plan AND planned AND NOT data UNION ALL SELECT project, false, 'review_missing', '' FROM f WHERE chapters AND plan AND planned AND data AND NOT pass AND NOT note
UNION ALL SELECT project, true, 'pass_unexpected', '' FROM f WHERE chapters AND plan AND planned AND data AND pass AND assembled AND (listed IS NULL OR listed NOT IN ('', 'reports/visual_pass_manifest.json')) UNION ALL SELECT project, false, 'pass_not_listed', '' FROM f WHERE chapters AND plan AND planned AND data AND pass AND assembled AND listed = ''
UNION ALL SELECT project, true, 'pass_not_there', '' FROM f WHERE chapters AND plan AND planned AND data AND NOT pass AND assembled AND coalesce(listed, '') <> ''
UNION ALL SELECT project, true, 'chapter_wrapped', path FROM c WHERE contains(text, '<body') UNION ALL SELECT project, true, 'chapter_without_workpack', path FROM c WHERE NOT EXISTS (SELECT 1 FROM files w WHERE w.project = c.project AND w.path = replace(replace(c.path, 'chapters/', 'chapter_workpacks/'), '.html', '_workpack.md'))
UNION ALL SELECT project, true, 'workpack_thin', path || ' (' || unnest(['too short to guide rich chapter writing', 'missing required workpack sections: Reader Decision, Reader Takeaway, Core Question, Required Answer Boundary, Paragraph Plan, Evidence Inputs']) || ')' FROM files WHERE path LIKE '%workpacks/%'
UNION ALL SELECT project, true, 'preset_unsupported', string_agg(DISTINCT v, ', ' ORDER BY v) FROM (SELECT project, regexp_extract(text, 'document_type_preset`?: `?([A-Za-z.]+)', 1) AS v FROM files WHERE path LIKE 'report_prd/%') WHERE lower(v) <> 'undecided' AND v <> 'memo' GROUP BY project
UNION ALL SELECT project, true, 'external_scripts', string_agg(path, ', ' ORDER BY path LIKE 'reports/chapters/%', path) FROM files WHERE (path = 'reports/final.html' OR path LIKE 'reports/chapters/%') AND contains(text, '<script') AND project IN (SELECT project FROM f WHERE assembled) GROUP BY project
UNION ALL SELECT project, true, 'chapter_changed', path FROM c JOIN f USING (project) WHERE assembled AND hashes > 0 AND coalesce(json_extract_string(m, '$.chapter_integrity[0].path') <> path OR json_extract_string(m, '$.chapter_integrity[0].sha256') <> sha256(text), true)
UNION ALL SELECT c.project, true, 'chapter_not_contained', c.path FROM c JOIN f USING (project) JOIN files r ON r.project = c.project AND r.path = 'reports/final.html' WHERE hashes > 0 AND NOT contains(r.text, c.text)
UNION ALL SELECT c.project, true, 'pass_stale', c.path FROM c JOIN f USING (project) JOIN files r ON r.project = c.project AND r.path = 'reports/visual_pass_manifest.json' WHERE chapters AND plan AND planned AND data AND c.path NOT LIKE '%/ch00%' AND json_extract_string(r.text, '$.body_chapter_integrity[0].sha256') <> sha256(c.text)
UNION ALL SELECT project, true, 'columns_missing', array_to_string(list_filter(['chapter', 'decision_use', 'purpose', 'status', 'visual_id', 'visual_type'], lambda x: x <> 'chapter' AND x <> 'status'), ', ') FROM v WHERE header = 0 GROUP BY project
UNION ALL SELECT project, true, 'roles_weak', string_agg(coalesce(nullif(visual_id, ''), 'row_' || place), ' | ' ORDER BY place) FROM v WHERE purpose = '' OR decision_use IS NULL GROUP BY project UNION ALL SELECT project, false, 'takeaway_weak', string_agg(coalesce(nullif(visual_id, ''), 'row_' || place), ' | ' ORDER BY place) FROM v WHERE expected_reader_takeaway IS NULL GROUP BY project
UNION ALL SELECT project, true, 'visual_without_data', name FROM n WHERE data_file = '' AND source_record IS NULL UNION ALL SELECT project, true, 'visual_data_missing', name || ': ' || data_file FROM n WHERE data_file <> '' AND data_file NOT LIKE 'http%' AND NOT EXISTS (SELECT 1 FROM files x WHERE x.project = n.project AND x.path = n.data_file)"""


@query(f"""WITH s AS (SELECT s_suppkey AS p FROM supplier), files AS ({_files_sql("sha256", "")}), w AS ({_VISUALS.format(t="s, range(1, 3) r(i)")}), c AS (SELECT * FROM files WHERE path LIKE 'reports/chapters/%'),
f AS (SELECT project, bool_or((path LIKE 'report_prd/%' OR path LIKE 'drafts/%') AND contains(lower(text), 'full report')) AS substantial, {", ".join(f"bool_or(path LIKE '{p}') AS {n}" for n, p in (("prd", "report_prd/%"), ("toc", "drafts/%toc%"), ("skeleton", "reports/major_skeleton.md"), ("workpacks", "%workpacks/%"), ("chapters", "reports/chapters/%"), ("cover", factory.COVER), ("assembled", "reports/final.html"), ("plan", factory.PLAN), ("data", "%/d.CSV"), ("note", factory.VISUAL_NOTE), ("pass", factory.VISUAL_PASS)))},
max(CASE WHEN path = '{factory.MANIFEST}' THEN text END) AS m, json_extract_string(m, '$.assembly_mode') AS mode, json_extract_string(m, '$.visual_pass_manifest') AS listed, coalesce(json_array_length(m, '$.chapter_integrity'), 0) AS hashes, trim(coalesce(json_extract_string(max(CASE WHEN path = '{factory.COVER}' THEN text END), '$.version'), '')) AS cv,
coalesce(max(CASE WHEN path = '{factory.POINTER}' AND json_valid(text) THEN json_extract_string(text, '$.version') END), '') AS pv, coalesce(max(CASE WHEN path = '{factory.POINTER}' AND json_valid(text) THEN json_extract_string(text, '$.version_key') END), '') AS pk, project IN (SELECT project FROM w) AS planned FROM files GROUP BY project),
v AS (SELECT w.* FROM w JOIN f USING (project) WHERE plan), n AS (SELECT *, coalesce(nullif(visual_id, ''), title, '(unnamed visual)') AS name FROM v WHERE required = 'YES' OR status = 'Planned'), g AS ({_GAP_RULES})
SELECT project, CASE WHEN gap AND project NOT IN ({", ".join(_LEGACY)}) THEN 'error' ELSE 'warning' END AS severity, CASE WHEN gap AND project IN ({", ".join(_LEGACY)}) THEN 'legacy:' ELSE '' END || rule AS rule, key FROM g""")
def factory_findings(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p"))
    files = spark.sql(f"WITH s AS (SELECT * FROM {{s}}) {_braced(_files_sql('sha2', ', 256'))}", s=s)
    numbered = s.select("p", F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    plan = spark.sql(_VISUALS.format(t="{n}"), n=numbered)
    all_columns = F.array(*map(F.lit, factory.PLAN_COLUMNS))
    plan = plan.withColumn("columns", F.when(F.col("header") == 0, F.array(F.lit("chapter"), F.lit("status"))).otherwise(all_columns))
    return factory.findings(files, plan, _MARKERS, _PRESETS, _LEGACY)


def _braced(sql: str) -> str:
    """Braces of JSON doubled, for a statement that is formatted."""
    return sql.replace("{", "{{").replace("}", "}}")


# Intake: documents as converted files of several suffixes, some failed


_PATHS = "'in/' || doc_id || (['.PDF', '.pptx', '.txt', '.docx', '.png', '', '.a.tiff'])[doc_id % 7 + 1]"
_ERROR = "CASE WHEN doc_id % 17 = 0 THEN 'ValueError' END"
_MARKDOWN = "CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '  ' || chr(10) WHEN doc_id % 5 = 0 THEN chr(10) || '## A  title #' || chr(10) || coalesce(text, '') ELSE text END"
_UNIT_SQL = rf"""f AS (SELECT doc_id, {_PATHS} AS path, {_ERROR} AS error, {_MARKDOWN} AS markdown FROM documents),
body AS (SELECT doc_id, path, regexp_replace(markdown, '^\s+|\s+$', '', 'g') AS t FROM f WHERE markdown IS NOT NULL AND doc_id % 7 NOT IN (2, 5)),
cut AS (SELECT doc_id, t, 0 AS a, 0 AS e FROM body UNION ALL SELECT doc_id, t, e AS a, CASE WHEN length(t) - e <= 4000 THEN length(t) WHEN length(regexp_extract(substr(t, e + 802, 3199), '(?s)^(.*)\n\n', 0)) > 0 THEN e + 801 + length(regexp_extract(substr(t, e + 802, 3199), '(?s)^(.*)\n\n', 1)) ELSE e + 4000 END FROM cut WHERE e < length(t)),
pieces AS (SELECT doc_id, a, regexp_replace(substr(t, a + 1, e - a), '^\s+|\s+$', '', 'g') AS x FROM cut WHERE e > a),
u AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'page' WHEN 1 THEN 'slide' ELSE 'chunk' END AS unit_type, row_number() OVER (PARTITION BY doc_id ORDER BY a)::INTEGER AS unit_no, trim(regexp_replace(string_split(x, chr(10))[1], '^[# ]+|[# ]+$', '', 'g')) AS h, x FROM pieces WHERE x <> '')"""


def _intake(spark, sf_dir):
    suffix = F.get(F.array(*map(F.lit, (".PDF", ".pptx", ".txt", ".docx", ".png", "", ".a.tiff"))), (F.col("doc_id") % 7).cast("int"))
    f = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("in/"), F.col("doc_id").cast("string"), suffix).alias("path"), F.expr(_ERROR).alias("error"), F.expr(_MARKDOWN).alias("markdown"))
    return f, units.intake_units(f, "doc_id", "path", "markdown")


@query(f"WITH RECURSIVE {_UNIT_SQL} SELECT doc_id, unit_type, unit_no, substr(h, 1, 160) AS heading, md5(x) AS md5, greatest(1, length(x) // 4)::INTEGER AS token_estimate FROM u")
def intake_units(spark, sf_dir):
    return _intake(spark, sf_dir)[1].select("doc_id", "unit_type", "unit_no", "heading", F.md5("text").alias("md5"), "token_estimate")


@query(rf"""WITH RECURSIVE {_UNIT_SQL}, n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id), k AS (SELECT f.*, doc_id % 7 NOT IN (2, 5) AS reads, coalesce(n, 0) AS n FROM f LEFT JOIN n USING (doc_id))
SELECT doc_id, CASE WHEN NOT reads THEN 'not_supported' WHEN error IS NOT NULL THEN 'error' ELSE 'normalized' END AS normalized_status, CASE WHEN NOT reads THEN 'not_supported' WHEN error IS NOT NULL THEN 'docling_error:ValueError' WHEN regexp_full_match(coalesce(markdown, ''), '\s*') THEN 'needs_ocr' ELSE 'docling_parsed' END AS parse_status,
CASE WHEN NOT reads THEN 'not_required' WHEN error IS NOT NULL OR doc_id % 7 IN (4, 6) THEN 'unknown' ELSE 'not_required' END AS ocr_status, CASE WHEN reads AND error IS NULL THEN 'pending_index' ELSE 'not_indexed' END AS context_index_status, CASE WHEN reads AND error IS NULL THEN n::VARCHAR ELSE '' END AS context_unit_count,
CASE WHEN reads AND error IS NULL AND doc_id % 7 < 2 THEN n::VARCHAR ELSE '' END AS page_count, CASE WHEN reads THEN 'references/normalized/' || doc_id || '/manifest.json' ELSE '' END AS manifest_path FROM k""")
def intake_states(spark, sf_dir):
    f, u = _intake(spark, sf_dir)
    return units.intake_states(f, u, "doc_id", "path", "markdown", "error")


# Profiles: a supplier is a document, its lines are counts of its profile, once as they should be and once as they were made

_KNOWN = sorted({p for _, paths, _ in profiles.FLAGS for p in paths} | {p for _, paths in profiles.METRICS for p in paths})
_ROWS = "SELECT l_suppkey AS doc, l_partkey % {m} AS i, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_linenumber + CASE WHEN {made} AND l_orderkey % 3 = 0 THEN 1 ELSE 0 END END::BIGINT AS value FROM lineitem WHERE l_linenumber < 3 AND l_partkey % 4 = l_suppkey % 4 AND NOT ({made} AND l_suppkey % 7 = 0)"
_NAMES = f"x(i, path) AS (VALUES {', '.join(f'({i}, {chr(39)}{p}{chr(39)})' for i, p in enumerate(_KNOWN))})"


def _profile_sql(made: str) -> str:
    return f"SELECT doc, path, value FROM ({_ROWS.format(m=len(_KNOWN) + 3, made=made)}) JOIN x USING (i)"


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(f"WITH {_NAMES}, t AS (SELECT doc, path, sum(value) AS n FROM ({_profile_sql('false')}) GROUP BY ALL) SELECT doc, " + ", ".join(f"coalesce(bool_or(n >= {least}) FILTER (path IN ({_listed(paths)})), false) AS {name}" for name, paths, least in profiles.FLAGS) + " FROM t GROUP BY doc")
def profile_flags(spark, sf_dir):
    return profiles.flags(_profile(spark, sf_dir, "false"))


def _profile(spark, sf_dir, made: str):
    rows = spark.sql(_ROWS.format(m=len(_KNOWN) + 3, made=made).replace("::BIGINT", "").replace("lineitem", "{l}"), l=read(spark, sf_dir, "lineitem"))
    return rows.select("doc", F.get(F.array(*map(F.lit, _KNOWN)), F.col("i").cast("int")).alias("path"), F.col("value").cast("long").alias("value")).filter("path is not null")


_METRIC_OF = "CASE " + " ".join(f"WHEN path IN ({_listed(paths)}) THEN '{name}'" for name, paths in profiles.METRICS) + " END"
_SCORES = f"""{_NAMES}, g AS ({_profile_sql('false')}), m AS ({_profile_sql('true')}), d AS (SELECT doc FROM g INTERSECT SELECT doc FROM m), k AS (SELECT doc, name FROM d, (VALUES {', '.join(f"('{n}')" for n, _ in profiles.METRICS)}) n(name)),
a AS (SELECT doc, {_METRIC_OF} AS name, sum(value) AS n FROM g GROUP BY ALL), b AS (SELECT doc, {_METRIC_OF} AS name, sum(value) AS n FROM m GROUP BY ALL),
s AS (SELECT doc, name, a.n IS NOT NULL OR b.n IS NOT NULL AS known, coalesce(a.n, 0) = coalesce(b.n, 0) AS same, round_even(1 - abs(coalesce(a.n, 0) - coalesce(b.n, 0))::DOUBLE / greatest(1, coalesce(a.n, 0), coalesce(b.n, 0)), 4) AS score FROM k LEFT JOIN a USING (doc, name) LEFT JOIN b USING (doc, name)),
w AS (SELECT doc, round_even(sum(round(score * 10000)::BIGINT)::DOUBLE / 14, 0) / 10000 AS score, count(*) FILTER (same) AS exact FROM s GROUP BY doc)"""


@query(f"WITH {_SCORES} SELECT * FROM w")
def profile_likeness(spark, sf_dir):
    return profiles.likeness(_profile(spark, sf_dir, "false"), _profile(spark, sf_dir, "true"))


@query(f"WITH {_SCORES} SELECT name AS metric, count(*) AS docs, count(*) FILTER (same) AS exact, round_even(avg(score), 4) AS mean, min(score) AS least FROM s WHERE known GROUP BY name UNION ALL SELECT 'all', count(*), count(*) FILTER (score >= 0.95), round_even(avg(score), 4), min(score) FROM w")
def profile_corpus(spark, sf_dir):
    gold, made = _profile(spark, sf_dir, "false"), _profile(spark, sf_dir, "true")
    return profiles.rolled_up(profiles.metric_scores(gold, made), profiles.likeness(gold, made))
