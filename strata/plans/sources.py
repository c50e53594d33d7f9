"""Queries on the integrity of sources and claims."""

from __future__ import annotations

from pyspark.sql import functions as F


from strata.operators import integrity, quality
from strata.plans.registry import query, read

# Registers made of parts: the key says what an index row, a record, a link and the evidence hold


def _pick(mod: int, values: list[str], shift: int = 0) -> str:
    return f"CASE (p + {shift}) % {mod} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_URL = _pick(11, ["'https://www.law.go.kr/'", "'https://www.law.go.kr/doc/' || p", "'refs/' || p || '.txt'", "'[x](https://example.org/a/' || p || ')'", "''", "'`https://example.org/b`'", "'refs/gone.txt'", "'https://fsc.go.kr'", "'refs/' || p || '.txt'", "'https://host.net/#top'", "NULL"])
_INDEX = f"""SELECT CASE WHEN p % 29 = 0 THEN ' `S' || p || '` ' WHEN p % 31 = 0 THEN '' WHEN p % 10 = 2 THEN 'goldman-' || p ELSE 'S' || p END AS source_id, {_pick(5, ["'report_citable'", "'`report_citable`'", "''", "'draft'", "'report_citable'"])} AS status, {_pick(4, ["'claim_ready'", "'report_citable'", "'collected'", "NULL"])} AS readiness,
{_pick(6, ["'전자금융거래법'", "'금융 보도자료'", "'Goldman report'", "'Notes'", "''", "NULL"])} AS title, {_pick(3, ["'금융위원회'", "'Ministry'", "NULL"])} AS publisher, {_URL} AS url_or_path, {_pick(7, ["'captured_webpage'", "'analysis_note'", "'original_official'", "''", "NULL", "'unknown_origin'", "'x'"])} AS evidence_class,
{_pick(4, ["'yes'", "'no'", "' Yes '", "NULL"], 1)} AS original_verified, {_pick(3, ["'Tier 1'", "'Tier 2'", "NULL"], 1)} AS reliability, {_pick(5, ["'ch1'", "''", "' '", "NULL", "'ch2'"], 2)} AS used_in FROM {{t}}"""
_QUOTE = "'A quote of the source numbered ' || p || ' that is long enough'"
_RECORDS = f"""SELECT CASE WHEN p % 10 = 2 THEN 'goldman-' || p ELSE 'S' || p END AS source_id, 900 + p % 300 AS size, 'head' || chr(10) || '## 1. Scope' || chr(10) || 'x' || chr(10) || '## 2. Exact Quotes' || chr(10) || CASE p % 4 WHEN 0 THEN '- "too short"' WHEN 3 THEN '' ELSE '1. ' || {_QUOTE} || chr(10) || '   ' END || chr(10) || '## 3. Rest' || chr(10) || 'short' AS text,
{_pick(4, ["''", "NULL", "'report_citable'", "''"])} AS status, {_pick(3, ["NULL", "''", "'quote_verified'"])} AS readiness, {_pick(4, ["''", "'설명자료'", "NULL", "'시행령'"], 1)} AS title, NULL AS publisher, {_pick(13, ["'refs/' || p || '.txt'", *["NULL"] * 12])} AS url_or_path, {_pick(8, ["'captured_webpage'", *["''"] * 7])} AS evidence_class, {_pick(6, ["'no'", *["NULL"] * 5])} AS original_verified,
{_pick(3, ["'cap.html'", "''", "NULL"])} AS capture_path, {_pick(4, ["''", "'refs/' || p || '.txt'", "'refs/none.txt'", "NULL"], 2)} AS local_original_path, {_pick(5, ["'p. 3'", *["NULL"] * 4])} AS source_locator, NULL AS exact_quote_location FROM {{t}} WHERE p % 8 <> 5"""
_LINKS = f"""SELECT CASE WHEN p % 10 = 2 THEN 'goldman-' || p ELSE 'S' || p END AS source_id, {_pick(4, ["'https://a.org/x'", "''", "'https://fss.or.kr/'", "NULL"], 3)} AS url, {_pick(4, ["'OK'", "'200'", "'dead'", "NULL"])} AS url_status, {_pick(3, ["'report_citable'", "'Quote_Verified'", "'internal'"])} AS use_level, {_pick(3, ["'loc'", "''", "NULL"], 1)} AS source_locator FROM {{t}} WHERE p % 3 <> 0"""
_FILES = f"""SELECT 'refs/' || p || '.txt' AS path, {_pick(4, ["'요약 및 분석 ' || p", "'제3조 https://a.org'", "'출처: 요약'", "'nothing'"])} AS text FROM {{t}} WHERE p % 4 <> 2 OR p % 8 = 2"""
_EVIDENCE = f"""SELECT CASE WHEN p % 10 = 2 THEN 'goldman-' || p ELSE 'S' || p END AS source_id, CASE p % 6 WHEN 0 THEN '[ Summary of 3 ]' || chr(10) || {_QUOTE} WHEN 1 THEN {_QUOTE} || ' and much more of the kept text around it, so that it is not thin at all' WHEN 2 THEN 'tiny' ELSE 'some other text that is kept and long enough to count but does not hold the quote looked for' END AS text FROM {{t}} WHERE p % 7 <> 3"""


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _generic(c: str) -> str:
    return f"(rtrim({c}, '/') IN ({', '.join(repr(h) for h in integrity.GENERIC_HOSTS)}) OR regexp_matches({c}, '^https?://[^/]+/?(#.*)?$'))"


def _original(c: str) -> str:
    hits = " + ".join(f"contains({c}, '{m}')::INT" for m in quality.SUMMARY_MARKERS)
    return f"NOT ({hits} >= 2 AND NOT regexp_matches({c}, 'https?://')) AND regexp_matches({c}, 'https?://') AND regexp_matches({c}, '{quality.ARTICLE_MARKER}')"


def _in(c: str, values) -> str:
    return f"{c} IN ({', '.join(repr(v) for v in values)})"


_CLEAN = r"regexp_replace(coalesce({c}, ''), '^[\s`]+|[\s`]+$', '', 'g')"
_LINKED = f"""regexp_replace(CASE WHEN regexp_extract({{c}}, '\\[[^\\]]*\\]\\(([^)]*)\\)', 1) <> '' THEN regexp_extract({{c}}, '\\[[^\\]]*\\]\\(([^)]*)\\)', 1) ELSE {{c}} END, '^[\\s`]+|[\\s`]+$', '', 'g')"""


def _first(n: str) -> str:
    return f"coalesce(nullif(r.{n}, ''), i.{n}, '')"


_WEB = "regexp_matches(url, '^https?://')"
_CITED = "record AND status = 'report_citable'"
_LISTED = "record AND index_status = 'report_citable'"
_SOURCE_RULES = [
    ("error", "citable_without_record", "NOT record AND index_status = 'report_citable'"), ("warning", "without_record", "NOT record AND index_status <> 'report_citable'"), ("error", "record_too_small", f"{_LISTED} AND size < 1024"), ("error", "link_url_generic", f"{_LISTED} AND link AND (link_url = '' OR {_generic('link_url')})"),
    ("error", "use_level_not_citable", f"{_LISTED} AND link AND NOT usable"), ("error", "url_status_not_verified", f"{_LISTED} AND link AND NOT {_in('url_status', integrity.VERIFIED)}"), ("error", "locator_missing", f"{_LISTED} AND link AND usable AND locator = ''"),
    ("error", "metadata_mismatch", f"{_CITED} AND regexp_matches(url, '^https?://(www[.])?law[.]go[.]kr([/?#]|$)') AND NOT {_any('said', quality.LAW_TITLES)} AND ({_any('said', quality.OTHER_TITLES)} OR {_any('publisher', quality.OTHER_PUBLISHERS)})"), ("error", "url_or_path_missing", f"{_CITED} AND url = ''"), ("error", "link_row_missing", f"{_CITED} AND {_WEB} AND NOT link"),
    ("error", "capture_missing", f"{_CITED} AND evidence_class = 'captured_webpage' AND capture = '' AND local_original = ''"), ("error", "local_original_not_original", f"{_CITED} AND lt IS NOT NULL AND NOT ({_original('lt')})"), ("warning", "path_not_found", f"record AND url <> '' AND NOT {_WEB} AND ut IS NULL"),
    ("error", "tier_1_not_original", f"record AND ut IS NOT NULL AND NOT ({_original('ut')}) AND contains(reliability, 'Tier 1')"), ("warning", "original_unclear", f"record AND ut IS NOT NULL AND NOT ({_original('ut')}) AND NOT contains(reliability, 'Tier 1')"),
    ("error", "path_not_of_source", "record AND ut IS NOT NULL AND contains(source_id, 'samsung')"), ("error", "original_txt_not_original", f"{_CITED} AND ut IS NOT NULL AND NOT ({_original('ut')})"), ("error", "homepage_cited", f"record AND {_WEB} AND {_generic('url')} AND ({_in('readiness', integrity.READY)} OR status = 'report_citable')"),
    ("error", "derived_tier_1", f"record AND {_in('evidence_class', integrity.DERIVED)} AND contains(reliability, 'Tier 1')"), ("error", "verified_homepage", f"record AND {_in('readiness', integrity.READY)} AND verified = 'yes' AND {_WEB} AND {_generic('url')}"),
    ("warning", "used_before_ready", f"record AND readiness <> '' AND NOT {_in('readiness', integrity.READY)} AND used_in <> ''"), ("warning", "used_unverified", "record AND verified = 'no' AND used_in <> ''"), ("error", "quotes_weak", f"{_CITED} AND p % 4 = 0"),
    ("error", "evidence_stub", f"{_CITED} AND kept AND p % 6 = 0"), ("error", "evidence_thin", f"{_CITED} AND kept AND p % 6 = 2"), ("error", "quotes_unproved", f"{_CITED} AND strong AND kept AND p % 6 NOT IN (0, 1)"),
    ("error", "quotes_without_evidence", f"{_CITED} AND strong AND NOT kept AND NOT {_WEB}"), ("error", "quotes_without_locator", f"{_CITED} AND strong AND NOT kept AND {_WEB} AND NOT located"),
]


@query(rf"""WITH t AS (SELECT p_partkey AS p FROM part), i AS ({_INDEX.replace("{t}", "t").replace("SELECT ", "SELECT p, ", 1)}), r AS ({_RECORDS.replace("{t}", "t")}), k AS ({_LINKS.replace("{t}", "t")}), f AS ({_FILES.replace("{t}", "t")}), n AS (SELECT *, {_CLEAN.format(c="source_id")} AS id FROM i),
j AS (SELECT n.p, n.id AS source_id, r.source_id IS NOT NULL AS record, k.source_id IS NOT NULL AS link, size, {_CLEAN.format(c="coalesce(nullif(i.status, ''), i.readiness)").replace("i.", "n.")} AS index_status, {_CLEAN.format(c="coalesce(nullif(n.status, ''), r.status, '')")} AS status, lower(coalesce(url_status, '')) AS url_status, lower(coalesce(use_level, '')) IN ('report_citable', 'quote_verified') AS usable,
trim(coalesce(k.url, '')) AS link_url, trim(coalesce(k.source_locator, '')) AS locator, {_LINKED.format(c=_first("url_or_path").replace("i.", "n."))} AS url, {_CLEAN.format(c=_first("evidence_class").replace("i.", "n."))} AS evidence_class, {_CLEAN.format(c=_first("readiness").replace("i.", "n."))} AS readiness, lower({_CLEAN.format(c=_first("original_verified").replace("i.", "n."))}) AS verified,
coalesce(n.reliability, '') AS reliability, coalesce(nullif(r.title, ''), nullif(n.title, ''), '') AS said, coalesce(n.publisher, '') AS publisher, trim(coalesce(n.used_in, '')) AS used_in, coalesce(capture_path, '') AS capture, coalesce(local_original_path, '') AS local_original, coalesce(nullif(k.source_locator, ''), r.source_locator) IS NOT NULL AS located,
n.p % 7 <> 3 AS kept, n.p % 4 IN (1, 2) AS strong FROM n LEFT JOIN r ON r.source_id = n.id LEFT JOIN k ON k.source_id = n.id WHERE n.id <> ''),
x AS (SELECT j.*, u.text AS ut, l.text AS lt FROM j LEFT JOIN f u ON u.path = j.url LEFT JOIN f l ON l.path = j.local_original)
{" UNION ALL ".join(f"SELECT source_id, '{s}' AS severity, '{r}' AS rule FROM x WHERE {c}" for s, r, c in _SOURCE_RULES)}""")
def source_findings(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    t = [spark.sql(s.replace("{t}", "{part}"), part=part) for s in (_INDEX, _RECORDS, _LINKS, _FILES, _EVIDENCE)]
    return integrity.source_findings(*t)


_CLAIMS = f"""SELECT CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'C' || o_orderkey END AS claim_id, {_pick(5, ["'Fact'", "'confirmed_fact'", "'opinion'", "NULL", "'artefact'"]).replace("p +", "o_orderkey +")} AS claim_type, {_pick(4, ["'direct_quote'", "' `Inference`'", "''", "NULL"]).replace("p +", "o_orderkey +")} AS citation_type,
{_pick(6, ["'Cited'", "'report_citable'", "'source_backed'", "'draft'", "NULL", "'cited'"], 1).replace("p +", "o_orderkey +")} AS status, {_pick(4, ["'K' || o_custkey || '; `K' || (o_custkey * 7)|| '`,'", "'K' || o_custkey", "''", "NULL"], 2).replace("p +", "o_orderkey +")} AS source_ids, {_pick(3, ["'analysis_note'", "'original_official'", "NULL"]).replace("p +", "o_orderkey +")} AS evidence_class,
{_pick(3, ["'NO'", "'yes'", "NULL"], 1).replace("p +", "o_orderkey +")} AS original_verified, {_pick(2, ["'no'", "'yes'"]).replace("p +", "o_orderkey +")} AS report_use_allowed, {_pick(3, ["'p. 1'", "' '", "NULL"], 2).replace("p +", "o_orderkey +")} AS exact_quote_location, {_pick(2, ["'a.md'", "NULL"], 1).replace("p +", "o_orderkey +")} AS evidence_paths, {_pick(3, ["'because'", "''", "NULL"]).replace("p +", "o_orderkey +")} AS notes FROM {{t}}"""
_CLAIM_RULES = [
    ("warning", "citation_type_missing", "lower(status) IN ('report_citable', 'cited') AND kind = ''"), ("error", "quote_without_place", "kind = 'direct_quote' AND place = ''"), ("warning", "inference_without_notes", "kind = 'inference' AND coalesce(notes, '') = ''"), ("error", "fact_from_derived", "fact AND evidence_class = 'analysis_note'"),
    ("error", "fact_unverified", "fact AND original_verified = 'NO'"), ("error", "fact_without_place", "fact AND place = ''"), ("error", "fact_without_evidence", "fact AND evidence_paths IS NULL"), ("warning", "legacy_status", "fact AND lower(status) IN ('cited', 'source_backed')"), ("error", "use_not_allowed", "report_use_allowed = 'no' AND lower(status) IN ('report_citable', 'cited')"),
]


@query(rf"""WITH q AS ({_CLAIMS.format(t="orders")}), c AS (SELECT *, lower({_CLEAN.format(c="citation_type")}) AS kind, trim(coalesce(exact_quote_location, '')) AS place, coalesce(contains(lower(claim_type), 'fact'), false) AS fact FROM q WHERE claim_id <> '')
{" UNION ALL ".join(f"SELECT claim_id, '{s}' AS severity, '{r}' AS rule, '' AS key FROM c WHERE {w}" for s, r, w in _CLAIM_RULES)}
UNION ALL SELECT DISTINCT claim_id, 'warning', 'source_unknown', k FROM (SELECT claim_id, regexp_replace(unnest(regexp_split_to_array(source_ids, '[,;]')), '[ `]', '', 'g') AS k FROM c) WHERE k <> '' AND k NOT IN (SELECT 'K' || c_custkey FROM customer)""")
def claim_findings(spark, sf_dir):
    claims = spark.sql(_CLAIMS.format(t="{o}"), o=read(spark, sf_dir, "orders"))
    return integrity.claim_findings(claims, read(spark, sf_dir, "customer").select(F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("id")))
