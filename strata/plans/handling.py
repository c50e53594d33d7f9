"""Queries on kept files, fields, sections, workpacks and the search over intake units."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import factory, units
from strata.operators import quality as Q
from strata.plans.projects import _UNIT_SQL, _intake
from strata.plans.registry import query, read
from strata.sources import headers

# Kept files: a document is a file whose key says where it lies

_PATH = "(['refs/received_originals/a.txt', 'refs/a.TXT', 'refs/received_originals/a.pdf', 'received_originals_b/a.txt'])[doc_id % 4 + 1]"
_HEAD = "(['요약 및 분석: ', '출처: 요약 ', 'https://a.example 제3조 ', ''])[doc_id % 5 % 4 + 1]"


@query(rf"""WITH f AS (SELECT doc_id, {_PATH} AS path, {_HEAD} || coalesce(text, '') AS t FROM documents), h AS (SELECT *, substr(t, 1, 1200) AS h, strlen(t) AS n FROM f), k AS (SELECT *, {" + ".join(f"contains(h, '{m}')::INT" for m in Q.SUMMARY_MARKERS)} AS hits, regexp_matches(h, 'https?://') AS web FROM h)
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN path LIKE '%.pdf' THEN 'non_txt_original' WHEN path LIKE '%/received_originals/%' AND n < 1024 THEN 'received_too_small' WHEN hits >= 2 AND NOT web THEN 'summary' WHEN contains(h, '출처:') AND contains(h, '요약') AND NOT web THEN 'note'
WHEN web AND regexp_matches(h, '{Q.ARTICLE_MARKER}') THEN 'original' ELSE 'unclear' END AS state FROM k""")
def file_originality(spark, sf_dir):
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    i = F.col("doc_id")
    text = F.concat(pick(("요약 및 분석: ", "출처: 요약 ", "https://a.example 제3조 ", ""), i % 5 % 4), F.coalesce("text", F.lit("")))
    path = pick(("refs/received_originals/a.txt", "refs/a.TXT", "refs/received_originals/a.pdf", "received_originals_b/a.txt"), i % 4)
    return read(spark, sf_dir, "documents").select("doc_id", Q.file_originality(path, i % 9 != 0, F.octet_length(text), text).alias("state"))


@query("""WITH f AS (SELECT doc_id, 4096 - 9 - length('% Placeholder PDF') - 12 + doc_id % 40 AS k FROM documents)
SELECT doc_id, CASE WHEN 9 + k + length('% Placeholder PDF') <= 4096 THEN 'dummy_marker: % Placeholder PDF' ELSE 'ok' END AS state FROM f""")
def pdf_marker_bound(spark, sf_dir):
    marker = "% Placeholder PDF"
    k = 4096 - 9 - len(marker) - 12 + F.col("doc_id") % 40
    body = F.concat(F.lit("%PDF-1.7\n"), F.repeat(F.lit("x"), k.cast("int")), F.lit(marker), F.lit(" rest of it %%EOF"))
    return read(spark, sf_dir, "documents").select("doc_id", Q.pdf_state(body.cast("binary")).alias("state"))


_FILES = "(['reports/a.html', 'references/Received_Originals/x.pdf', 'data/b.CSV', 'a/.env.json', 'preserved_originals/secrets.md', 'tool.exe', 'my_token.xlsx', 'noext', 'x.tar.gz', 'drafts/'])[p_partkey % 10 + 1] || CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR ELSE '' END"


@query(f"""WITH f AS (SELECT p_partkey, {_FILES} AS path FROM part), w AS (SELECT *, lower(path) AS l FROM f),
r AS (SELECT *, CASE WHEN contains(l, '.env') OR contains(l, 'cookie') OR contains(l, 'secret') OR contains(l, 'token') THEN '{Q.REASONS[1]}' WHEN contains(l, 'received_originals') OR contains(l, 'preserved_originals') THEN '{Q.REASONS[0]}' WHEN regexp_matches(l, '[^/][.](html|json|md|csv|xlsx|xls|tsv|pdf|docx)$') THEN '' ELSE '{Q.REASONS[2]}' END AS reason FROM w)
SELECT p_partkey, path, reason = '' AS include, reason FROM r""")
def handoff_rows(spark, sf_dir):
    names = ("reports/a.html", "references/Received_Originals/x.pdf", "data/b.CSV", "a/.env.json", "preserved_originals/secrets.md", "tool.exe", "my_token.xlsx", "noext", "x.tar.gz", "drafts/")
    k = F.col("p_partkey")
    path = F.concat(F.get(F.array(*map(F.lit, names)), (k % 10).cast("int")), F.when(k % 3 == 0, k.cast("string")).otherwise(""))
    return read(spark, sf_dir, "part").select("p_partkey", path.alias("path"), Q.handoff(path).alias("h")).select("p_partkey", "path", "h.*")


# Fields and sections

_FIELD = "(['`x` # note', ' v (old) | z', 'N/A', '미정', 'a#b', 'u // c', '``', 'k | w', 'None ', 'http://h/p'])[p_partkey % 10 + 1]"
_FIELDS = ("`x` # note", " v (old) | z", "N/A", "미정", "a#b", "u // c", "``", "k | w", "None ", "http://h/p")
_LINK = "(['[a](b.md) and [c](d)', ' `plain` ', '[broken](', '', 'x](y)z'])[p_partkey % 5 + 1]"
_LINKS = ("[a](b.md) and [c](d)", " `plain` ", "[broken](", "", "x](y)z")


@query(rf"""WITH f AS (SELECT p_partkey, {_FIELD} || CASE WHEN p_partkey % 7 = 0 THEN ' (' || p_name ELSE '' END AS field, {_LINK} AS link FROM part), b AS (SELECT *, trim(regexp_replace(trim(field), '^`+|`+$', '', 'g')) AS bare FROM f), v AS (SELECT *, trim(regexp_extract(bare, '(?s)^(.*?)(\s+(#|\(|//|\|).*)?$', 1)) AS v FROM b)
SELECT p_partkey, CASE WHEN lower(v) IN ('', 'n/a', 'na', 'none', 'null', 'undecided', '미정') THEN '' ELSE v END AS value, CASE WHEN regexp_extract(link, '\]\(([^)]+)\)', 1) <> '' THEN regexp_extract(link, '\]\(([^)]+)\)', 1) ELSE trim(link, '` ') END AS target FROM v""")
def clean_fields(spark, sf_dir):
    k = F.col("p_partkey")
    field = F.concat(F.get(F.array(*map(F.lit, _FIELDS)), (k % 10).cast("int")), F.when(k % 7 == 0, F.concat(F.lit(" ("), "p_name")).otherwise(""))
    link = F.get(F.array(*map(F.lit, _LINKS)), (k % 5).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", T.clean_field(field).alias("value"), T.link_target(link).alias("target"))


@query("""WITH c AS (SELECT c_nationkey AS n, c_custkey AS k FROM customer) SELECT n AS path, coalesce(array_to_string(list_sort(list(DISTINCT 'C' || k) FILTER (k % 4 = 0)), ','), '') AS claims, coalesce(array_to_string(list_sort(list(DISTINCT 'S' || (k % 50)) FILTER (k % 4 <> 0 AND k % 5 <> 0)), ','), '') AS sources FROM c GROUP BY n""")
def section_ids(spark, sf_dir):
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(k % 4 == 0, F.concat(F.lit("| `C"), k.cast("string"), F.lit("` | x |"))).alias("claim"), F.when(k % 4 != 0, F.concat(F.when(k % 5 == 0, "| two words S").otherwise("|S"), (k % 50).cast("string"), F.lit(" | y | z |"))).alias("source"))
    rows = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(n).isNotNull(), F.struct("c_custkey", F.col(n).alias("l"))))), lambda s: s["l"]), "\n")
    d = c.groupBy("c_nationkey").agg(rows("claim").alias("a"), rows("source").alias("b"))
    text = F.concat(F.lit("# T\n| S0 | no section |\n## 1. Claim Register Links (all)\n| claim_id | t |\n|:---|---|\n"), "a", F.lit("\n| loose line\n## Evidence Inputs\n| Source_ID | t |\n| --- | --- | --- |\n"), "b", F.lit("\n|  | empty |\n### 3. Rest\n| S99 | other |\n"))
    return d.select(F.col("c_nationkey").alias("path"), F.array_join(headers.named_ids(text, "Claim Register Links", "claim_id"), ",").alias("claims"), F.array_join(headers.named_ids(text, "Evidence Inputs", "source_id"), ",").alias("sources"))


# Workpacks: a document with the sections that its key leaves in

_MARKS = [f"CASE WHEN doc_id % {i + 2} <> 1 THEN '## {m.upper() if i % 2 else m}' || chr(10) ELSE '' END" for i, m in enumerate(factory.SECTIONS)]
_PACK = " || ".join(_MARKS) + " || CASE doc_id % 6 WHEN 0 THEN '- Chapter_id:  ' || chr(10) WHEN 1 THEN '| 1 |  | | |' WHEN 2 THEN '| a | b |' ELSE '' END || coalesce(text, '')"


@query(rf"""WITH p AS (SELECT doc_id, {_PACK} AS t FROM documents), q AS (SELECT doc_id, t, list_filter([{", ".join(f"CASE WHEN contains(lower(t), '{m.lower()}') THEN NULL ELSE '{m}' END" for m in factory.SECTIONS)}], lambda m: m IS NOT NULL) AS lacks FROM p)
SELECT doc_id, concat_ws('; ', CASE WHEN length(regexp_replace(t, '^\s+|\s+$', '', 'g')) < 900 THEN 'too short to guide rich chapter writing' END, CASE WHEN len(lacks) > 0 THEN 'missing required workpack sections: ' || array_to_string(lacks[1:6], ', ') END,
CASE WHEN regexp_matches(t, '(?im)-\s*chapter_id:\s*$|\|\s*\|\s*\|\s*\||\|\s*1\s*\|\s*\|\s*\|\s*\|') THEN 'contains unfilled template placeholders' END) AS issues FROM q""")
def workpack_issues(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(factory.workpack_issues(F.expr(_PACK)), "; ").alias("issues"))


# The search over units, by text or heading

_TERM = "a __itle"


@query(rf"""WITH RECURSIVE {_UNIT_SQL}, n AS (SELECT doc_id::VARCHAR AS reference_id, unit_type, unit_no::VARCHAR AS unit_no, substr(h, 1, 160) AS heading, CASE WHEN doc_id % 4 = 0 THEN '' ELSE greatest(1, length(x) // 4)::VARCHAR END AS token_estimate, 'u/' || doc_id || '.csv' AS unit_path, x AS text FROM u)
SELECT reference_id, unit_type, unit_no, heading, token_estimate, unit_path, substr(text, 1, 1200) AS text_preview FROM n WHERE lower(text) LIKE '%{_TERM}%' OR lower(heading) LIKE '%{_TERM}%' ORDER BY try_cast(nullif(token_estimate, '') AS INTEGER) NULLS LAST, reference_id, unit_no::INTEGER LIMIT 8""")
def unit_search(spark, sf_dir):
    u = _intake(spark, sf_dir)[1]
    estimate = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("token_estimate").cast("string"))
    rows = u.select(F.col("doc_id").cast("string").alias("reference_id"), "unit_type", F.col("unit_no").cast("string").alias("unit_no"), "heading", "text", estimate.alias("token_estimate"), F.concat(F.lit("u/"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("unit_path"))
    return units.search_intake(rows, _TERM)
