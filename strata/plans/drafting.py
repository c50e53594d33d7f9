"""Queries on drafts: outline scores, chapter advice, assembly, allow-lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import drafts as D
from strata.plans.registry import query, read

_HEADS = (
    "## 제 1 장 핵심 논지\n독자 의사결정 질문, 필요 자료 원문, 리스크와 대안, 데이터.csv 와 그래프, 주장과 미해결 쟁점, 챕터별 순차, docx\n제0장 요약\n",
    "목차는 12장으로 고정\n# Chapter 0\nThesis, Decision, risk, SOURCE, scenario and chart; claim; section-by-section; template\n",
    "### 2. <table><tr> reader, evidence, chart\n근거 데이터: 완벽\n",
    "",
)
_DRAFTS = "SELECT doc_id, ([" + ", ".join("'" + h.replace("\n", "' || chr(10) || '") + "'" for h in _HEADS) + "])[(doc_id % 4 + 1)::INTEGER] || coalesce(text, '') AS t FROM documents"


def _drafts(spark, sf_dir):
    k = F.col("doc_id")
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (k % 4 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def _m(pattern: str) -> str:
    return f"regexp_matches(t, '{pattern}')" if pattern.startswith("(?") else f"regexp_matches(t, '(?i){pattern}')"


_SUM_AXES = " + ".join(f"{_m(a)}::INT" for a in D.AXES)
_PARTS = [("scope", 15, f"({_m(D.SECTIONS)} AND {_SUM_AXES} >= 3)"), *[(n, p, _m(x)) for n, p, x in D.PARTS]]
_EARNED = " + ".join(f"{p} * {ok}::INT" for _, p, ok in _PARTS)
_MISSING = ", ".join(f"CASE WHEN NOT {ok} THEN '{n}' END" for n, _, ok in _PARTS)


@query(rf"""WITH d AS ({_DRAFTS}), s AS (SELECT doc_id, ({_EARNED})::BIGINT AS earned,
(15 * {_m(D.MARKUP)}::INT + 10 * (length(t) < 3000)::INT + 10 * {_m(D.FIXED_COUNT)}::INT + 8 * (NOT (contains(t, '0장') OR contains(lower(t), 'chapter 0')))::INT)::BIGINT AS deducted,
list_filter([{_MISSING}], lambda x: x IS NOT NULL) AS m FROM d), r AS (SELECT *, greatest(0, least(100, earned - deducted))::BIGINT AS score FROM s)
SELECT doc_id, earned, deducted, array_to_string(m[1:8], ',') AS missing, score, CASE WHEN score < 70 THEN 'expansion,delivery' WHEN score < 80 THEN 'delivery' ELSE '' END AS blocked FROM r""")
def outline_score(spark, sf_dir):
    return D.outline_score(_drafts(spark, sf_dir), "doc_id", "text")


def _in(terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(t), '{x.lower()}')" for x in terms) + ")"


@query(rf"""WITH d AS ({_DRAFTS}), c AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE t END AS raw, CASE WHEN doc_id % 11 = 0 THEN '' ELSE t END AS t, doc_id % 10 = 1 AS summary,
doc_id % 7 <> 0 AS plan_exists, (doc_id % 5) / 4.0 AS coverage, (doc_id % 9) / 20.0 AS overlap, doc_id % 3 AS claims, doc_id % 2 AS visuals, greatest(0, doc_id % 6 - 3) AS thin, doc_id % 4 AS tables FROM d),
o AS (SELECT *, list_filter([{", ".join(f"CASE WHEN contains(t, '{x}') THEN '{x}' END" for x in D.OVERCLAIMS)}], lambda x: x IS NOT NULL) AS over FROM c),
a AS (SELECT *, list_filter([CASE WHEN NOT plan_exists THEN 'create_plan' WHEN coverage < 0.7 THEN 'complete_plan' WHEN overlap < 0.18 AND NOT summary THEN 'answer_plan' END,
CASE WHEN claims > 0 THEN 'link_claims' END, CASE WHEN visuals > 0 THEN 'link_visuals' END, CASE WHEN length(t) < CASE WHEN summary THEN 900 ELSE 1200 END THEN 'expand' END,
CASE WHEN thin > 0 THEN 'expand_sections' END, CASE WHEN NOT summary AND NOT {_in(D.DECISION)} THEN 'name_decision' END, CASE WHEN NOT summary AND NOT {_in(D.RISK)} THEN 'name_risks' END,
CASE WHEN NOT {_in(D.EVIDENCE)} THEN 'cite' END, CASE WHEN NOT contains(t, '근거 데이터') AND tables > 0 THEN 'caption_data' END, CASE WHEN len(over) > 0 THEN 'qualify' END], lambda x: x IS NOT NULL) AS advice FROM o)
SELECT doc_id, CASE WHEN raw IS NULL THEN 'missing' WHEN len(advice) > 0 THEN 'needs_attention' ELSE 'strong_signal' END AS status, array_to_string(advice, ',') AS advice, array_to_string(over, '|') AS overclaims FROM a""")
def chapter_advice(spark, sf_dir):
    k = F.col("doc_id")
    c = _drafts(spark, sf_dir).select(
        k, F.when(k % 11 != 0, F.col("text")).alias("text"), (k % 10 == 1).alias("summary"), (k % 7 != 0).alias("plan_exists"), (k % 5 / 4).alias("plan_coverage"), (k % 9 / 20).alias("plan_overlap"),
        (k % 3).alias("unlinked_claims"), (k % 2).alias("unlinked_visuals"), F.greatest(F.lit(0), k % 6 - 3).alias("thin"), (k % 4).alias("tables"), F.lit(0).alias("figures"),
    )
    return D.chapter_advice(c, "doc_id")


@query("""WITH p AS (SELECT conv_id, 'ch' || turn AS name, text FROM conversations), m AS (SELECT conv_id, 'ch' || turn AS name, -turn AS place FROM conversations WHERE conv_id % 2 = 0 AND turn % 3 <> 1
UNION ALL SELECT DISTINCT conv_id, 'absent', 1 FROM conversations WHERE conv_id % 4 = 0),
b AS (SELECT conv_id, place, name, text, p.conv_id IS NOT NULL AS there FROM m LEFT JOIN p USING (conv_id, name) UNION ALL SELECT conv_id, 0, name, text, true FROM p WHERE conv_id NOT IN (SELECT conv_id FROM m))
SELECT conv_id, count(*) FILTER (there) AS n_parts, count(*) FILTER (NOT there) AS missing, coalesce(string_agg(coalesce(text, ''), '' ORDER BY place, name) FILTER (there), '') AS body FROM b GROUP BY conv_id""")
def assembled(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    name = F.concat(F.lit("ch"), F.col("turn").cast("string")).alias("name")
    listed = c.filter("conv_id % 2 = 0 AND turn % 3 <> 1").select("conv_id", name, (-F.col("turn")).alias("place"))
    absent = c.filter("conv_id % 4 = 0").select("conv_id", F.lit("absent").alias("name"), F.lit(1).alias("place")).distinct()
    return D.assembled(c.select("conv_id", name, "text"), listed.unionByName(absent), "conv_id", "name", "text")


_STYLE = "'Color : ' || p_brand || ' ; page-break-before:always; position:fixed;x;margin:' || CASE p_partkey % 3 WHEN 0 THEN ' URL (a:b)' WHEN 1 THEN '' ELSE '1pt:2pt ' END || ';width:@import' || p_size"
_NAME = "CASE p_partkey % 7 WHEN 0 THEN '/' WHEN 1 THEN '../' WHEN 2 THEN 'a/../' WHEN 3 THEN 'c:' WHEN 4 THEN 'a' || chr(92) WHEN 5 THEN 'a..b/./' ELSE '' END || CASE WHEN p_partkey % 14 = 6 THEN '' ELSE p_name END"


@query(rf"""WITH s AS (SELECT p_partkey, {_STYLE} AS style, {_NAME} AS name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || p_brand || ' ' WHEN 2 THEN lower(replace(p_type, ' ', '_')) END AS word FROM part),
d AS (SELECT p_partkey, i, lower(trim(split_part(d, ':', 1))) AS n, trim(substr(d, instr(d, ':') + 1)) AS v FROM (SELECT p_partkey, unnest(string_split(style, ';')) AS d, unnest(generate_series(1, len(string_split(style, ';')))) AS i FROM s) WHERE contains(d, ':')),
g AS (SELECT p_partkey, string_agg(regexp_replace(n, '^page-break-(before|after)$', 'break-\1') || ':' || v, ';' ORDER BY i) AS style FROM d WHERE n IN ({", ".join(f"'{x}'" for x in D.STYLES)}) AND v <> '' AND NOT regexp_matches(v, '(?i)url\s*\(|@import') GROUP BY p_partkey)
SELECT s.p_partkey, coalesce(g.style, '') AS style, coalesce(nullif(substr(regexp_replace(trim(coalesce(word, '')), '[^A-Za-z0-9_.:-]+', '-', 'g'), 1, 160), ''), 'report') AS ref,
CASE WHEN regexp_full_match(coalesce(upper(trim(nullif(word, ''))), 'NONE'), '[\p{{L}}\p{{N}}_]+') THEN coalesce(upper(trim(nullif(word, ''))), 'NONE') ELSE 'NONE' END AS enum,
name <> '' AND NOT contains(name, chr(92)) AND NOT starts_with(name, '/') AND NOT contains(name, ':') AND NOT list_contains(string_split(name, '/'), '..') AS entry FROM s LEFT JOIN g USING (p_partkey)""")
def allow_lists(spark, sf_dir):
    s = read(spark, sf_dir, "part").select("p_partkey", F.expr(_STYLE).alias("style"), F.expr(_NAME.replace("chr(92)", "char(92)")).alias("name"), F.expr("CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || p_brand || ' ' WHEN 2 THEN lower(replace(p_type, ' ', '_')) END").alias("word"))
    return s.select("p_partkey", D.safe_style(F.col("style")).alias("style"), D.safe_ref(F.col("word")).alias("ref"), D.safe_enum(F.col("word"), "NONE").alias("enum"), D.safe_entry(F.col("name")).alias("entry"))


@query("SELECT page_id, url, length(html) AS chars FROM pages")
def public_fields(spark, sf_dir):
    inner = F.struct(F.col("html").alias("payload"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.length("html").cast("long").alias("chars"))
    p = read(spark, sf_dir, "pages").select("page_id", F.struct("url", inner.alias("inner")).alias("s"))
    s = p.select("page_id", D.public_struct(F.col("s"), ("inner.payload", "inner.digest")).alias("s"))
    return s.select("page_id", "s.url", "s.inner.*")
