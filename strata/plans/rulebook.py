"""Queries on sources, files, fields, layouts and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strata.functions import korean
from strata.functions import text as T
from strata.operators import quality as Q
from strata.operators import rules, sinks
from strata.plans.registry import query, read


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_FILES = "SELECT p_partkey AS k, replace(p_name, ' ', '/') || CASE p_partkey % 7 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' WHEN 2 THEN '/visual_plan.csv' WHEN 3 THEN '.md' WHEN 4 THEN '' WHEN 5 THEN '.tsv' ELSE '.xls.bak' END AS path FROM part"


def _files(spark, sf_dir):
    k = F.col("p_partkey")
    end = F.element_at(F.array(*map(F.lit, (".csv", ".XLSX", "/visual_plan.csv", ".md", "", ".tsv", ".xls.bak"))), (k % 7 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), end).alias("path"))


@query(rf"""WITH f AS ({_FILES}) SELECT k, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS suffix, lower(regexp_extract(path, '\.([^./]+)$', 1)) IN ('csv', 'xlsx', 'xls', 'tsv') AND lower(regexp_extract(path, '([^/]*)$', 1)) <> 'visual_plan.csv' AS backing FROM f""")
def backing_files(spark, sf_dir):
    return _files(spark, sf_dir).select("k", Q.suffix(F.col("path")).alias("suffix"), Q.backing_data(F.col("path")).alias("backing"))


_SOURCES = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '보도자료 ' || source WHEN 1 THEN '금융  시행령' WHEN 2 THEN '정책 공약집' ELSE coalesce(source, '') END AS title,
CASE doc_id % 3 WHEN 0 THEN '금융위원회' ELSE lang END AS publisher, CASE doc_id % 5 WHEN 0 THEN 'https://WWW.law.go.kr/a?b' WHEN 1 THEN 'http://law.go.kr' WHEN 2 THEN 'law.go.kr/x' ELSE 'https://example.org/law.go.kr' END AS url FROM documents"""


def _sources(spark, sf_dir):
    i = F.col("doc_id")
    title = F.when(i % 4 == 0, F.concat(F.lit("보도자료 "), "source")).when(i % 4 == 1, "금융  시행령").when(i % 4 == 2, "정책 공약집").otherwise(F.coalesce("source", F.lit("")))
    url = F.when(i % 5 == 0, "https://WWW.law.go.kr/a?b").when(i % 5 == 1, "http://law.go.kr").when(i % 5 == 2, "law.go.kr/x").otherwise("https://example.org/law.go.kr")
    return read(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.when(i % 3 == 0, "금융위원회").otherwise(F.col("lang")).alias("publisher"), url.alias("url"))


@query(rf"""WITH s AS ({_SOURCES}), h AS (SELECT doc_id, coalesce(title, '') AS t, coalesce(publisher, '') AS p, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) IN ('law.go.kr', 'www.law.go.kr') AS portal FROM s)
SELECT doc_id, CASE WHEN portal AND NOT {_any("t", Q.LAW_TITLES)} AND {_any("t", Q.OTHER_TITLES)} THEN 'title' WHEN portal AND NOT {_any("t", Q.LAW_TITLES)} AND {_any("p", Q.OTHER_PUBLISHERS)} THEN 'publisher' ELSE '' END AS mismatch FROM h""")
def metadata_mismatch(spark, sf_dir):
    return _sources(spark, sf_dir).select("doc_id", Q.metadata_mismatch(F.col("title"), F.col("publisher"), F.col("url")).alias("mismatch"))


_IDS = "SELECT doc_id, (['goldman-', 'x-Robinhood-', 'samsung', 'regulator_', 'src-'])[(doc_id % 5 + 1)::INTEGER] || doc_id AS id, (['10-K filing', '삼성 report', 'an agency', 'other'])[(doc_id % 4 + 1)::INTEGER] AS title, 'a/b/' || coalesce(source, 'none') || '.md' AS path FROM documents"


@query(f"""WITH i AS ({_IDS}), l AS (SELECT doc_id, lower(id) AS id, lower(concat_ws(' ', id, title, regexp_extract(path, '([^/]*)$', 1))) AS t FROM i)
SELECT doc_id, CASE {" ".join(f"WHEN contains(id, '{m}') THEN {_any('t', w)}" for m, w in Q.ID_MARKERS.items())} ELSE true END AS fits FROM l""")
def id_fits(spark, sf_dir):
    i = F.col("doc_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(pick(("goldman-", "x-Robinhood-", "samsung", "regulator_", "src-")), i.cast("string")).alias("id"), pick(("10-K filing", "삼성 report", "an agency", "other")).alias("title"), F.concat(F.lit("a/b/"), F.coalesce("source", F.lit("none")), F.lit(".md")).alias("path"))
    return d.select("doc_id", Q.id_fits(F.col("id"), F.col("title"), F.col("path")).alias("fits"))


_NOTES = "SELECT doc_id, (['요약 및 분석: ', '출처: 요약 ', 'https://a.example 제3조 ', '[Market Overview] ', ''])[(doc_id % 5 + 1)::INTEGER] || coalesce(text, '') AS text FROM documents"


def _notes(spark, sf_dir):
    heads = ("요약 및 분석: ", "출처: 요약 ", "https://a.example 제3조 ", "[Market Overview] ", "")
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


@query(rf"""WITH n AS ({_NOTES}), h AS (SELECT doc_id, substr(text, 1, 1200) AS h, {" + ".join(f"contains(substr(text, 1, 1200), '{m}')::INTEGER" for m in Q.SUMMARY_MARKERS)} AS hits FROM n)
SELECT doc_id, CASE WHEN hits >= 2 AND NOT regexp_matches(h, 'https?://') THEN 'summary' WHEN contains(h, '출처:') AND contains(h, '요약') AND NOT regexp_matches(h, 'https?://') THEN 'note'
WHEN regexp_matches(h, 'https?://') AND regexp_matches(h, '{Q.ARTICLE_MARKER}') THEN 'original' ELSE 'unclear' END AS state FROM h""")
def original_state(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", Q.original_state(F.col("text")).alias("state"))


#: Headings after some characters of three bytes, so that the bound of 300 bytes falls before, within and behind them.
_LATE = "repeat('가', (doc_id % 30 + 80)::INTEGER) || chr(10) || '[Market Overview]' || chr(10) || text"


@query(rf"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN {_LATE} ELSE text END AS text FROM ({_NOTES}))
SELECT doc_id, regexp_matches(left(text, list_max(list_filter(range(0, 301), lambda n: strlen(left(text, n)) <= 300))), '{Q.STUB_HEADING}') AS stub FROM n""")
def stub_headings(spark, sf_dir):
    late = F.concat(F.repeat(F.lit("가"), (F.col("doc_id") % 30 + 80).cast("int")), F.lit("\n[Market Overview]\n"), "text")
    text = F.when(F.col("doc_id") % 5 == 4, late).otherwise(F.col("text"))
    return _notes(spark, sf_dir).select("doc_id", Q.stub_heading(text).alias("stub"))


@query(f"""WITH f AS (SELECT page_id, html, (['%PDF-1.7 ', '%PDF-1.4 % Dummy PDF ', 'x', '%PDF-1.7 % Placeholder PDF '])[(page_id % 4 + 1)::INTEGER] || repeat(coalesce(html, ''), 4) || CASE WHEN page_id % 3 = 0 THEN '' ELSE '%%EOF' END AS t FROM pages),
h AS (SELECT page_id, CASE WHEN html IS NULL THEN NULL ELSE t END AS t, octet_length(encode(t)) AS n FROM f)
SELECT page_id, CASE WHEN t IS NULL THEN 'missing' WHEN n < 4096 THEN 'small' {" ".join(f"WHEN contains(substr(t, 1, 200), '{m}') THEN 'dummy_marker: {m}'" for m in Q.DUMMY_PDF_MARKERS)}
WHEN NOT starts_with(t, '%PDF-') OR NOT contains(t, '%%EOF') THEN 'parse_error' ELSE 'ok' END AS state FROM h""")
def pdf_state(spark, sf_dir):
    i, heads = F.col("page_id"), ("%PDF-1.7 ", "%PDF-1.4 % Dummy PDF ", "x", "%PDF-1.7 % Placeholder PDF ")
    t = F.concat(F.element_at(F.array(*map(F.lit, heads)), (i % 4 + 1).cast("int")), F.repeat(F.col("html"), F.lit(4)), F.when(i % 3 == 0, "").otherwise("%%EOF"))
    return read(spark, sf_dir, "pages").select("page_id", Q.pdf_state(t.cast("binary")).alias("state"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def public_columns(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_name").alias("Phone_1"), "c_acctbal", F.col("c_mktsegment").alias("c_NOTES"))
    return Q.without_private(c)


_STATUS = "SELECT event_id, (CASE event_id % 3 WHEN 0 THEN ' M ' WHEN 1 THEN 'R  ' ELSE '?? ' END) || CASE WHEN event_id % 3 = 1 THEN 'old\\name -> ' ELSE '' END || event_type || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '\\x.py' WHEN 2 THEN '2/y' ELSE '/z' END AS line FROM events"


@query(f"""WITH s AS ({_STATUS}), p AS (SELECT event_id, line, replace(substr(line, 4), '\\', '/') AS p FROM s), q AS (SELECT event_id, regexp_replace(p, '^.*? -> ', '') AS path FROM p)
SELECT event_id, path FROM q WHERE path IN ('click', 'view') OR starts_with(path, 'click/') OR starts_with(path, 'view/')""")
def core_changes(spark, sf_dir):
    i = F.col("event_id")
    line = F.concat(F.when(i % 3 == 0, " M ").when(i % 3 == 1, "R  ").otherwise("?? "), F.when(i % 3 == 1, "old\\name -> ").otherwise(""), "event_type", F.when(i % 4 == 0, "").when(i % 4 == 1, "\\x.py").when(i % 4 == 2, "2/y").otherwise("/z"))
    e = read(spark, sf_dir, "events").select("event_id", Q.changed_path(line).alias("path"))
    return e.filter(Q.within(F.col("path"), ("click/", "view")))


@query("""WITH r AS (SELECT o_orderkey, [CASE WHEN o_orderkey % 3 = 0 THEN 'doc/' || o_custkey END, CASE WHEN o_orderkey % 2 = 0 THEN 'doc/' || o_custkey ELSE '' END, 'doc/' || (o_orderkey % 50), 'doc/0'] AS ps FROM orders),
e AS (SELECT o_orderkey, unnest(ps) AS path, unnest(generate_series(0, 3))::INTEGER AS n FROM r), f AS (SELECT 'doc/' || doc_id AS path FROM documents)
SELECT o_orderkey, min(n) AS n, path FROM e WHERE path IN (SELECT path FROM f) GROUP BY o_orderkey, path""")
def evidence_paths(spark, sf_dir):
    k, name = F.col("o_orderkey"), lambda c: F.concat(F.lit("doc/"), c.cast("string"))
    r = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, name(F.col("o_custkey"))).alias("a"), F.when(k % 2 == 0, name(F.col("o_custkey"))).otherwise("").alias("b"), name(k % 50).alias("c"), F.lit("doc/0").alias("d"))
    files = read(spark, sf_dir, "documents").select(name(F.col("doc_id")).alias("path"))
    return Q.evidence_paths(r, files, "o_orderkey", ["a", "b", "c", "d"], "path")


# Fields and texts


_TABLES = "SELECT conv_id, string_agg(CASE WHEN turn % 3 = 0 THEN '| ' || role || ' | ' || turn || ' |' WHEN turn % 3 = 1 THEN '|---|:-:|' ELSE '- `Status`: ' || CASE WHEN turn % 2 = 0 THEN ' n/a' ELSE role END END, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id"


def _tables(spark, sf_dir):
    n = F.col("turn")
    line = F.when(n % 3 == 0, F.concat(F.lit("| "), "role", F.lit(" | "), n.cast("string"), F.lit(" |"))).when(n % 3 == 1, "|---|:-:|").otherwise(F.concat(F.lit("- `Status`: "), F.when(n % 2 == 0, " n/a").otherwise(F.col("role"))))
    c = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("s"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("t"))


@query(rf"""WITH t AS ({_TABLES}), l AS (SELECT conv_id, unnest(string_split(t, chr(10))) AS l FROM t)
SELECT conv_id, greatest(0, count(*) FILTER (starts_with(trim(l), '|') AND ends_with(trim(l), '|') AND NOT regexp_full_match(trim(l), '[|:\- ]*')) - 1)::BIGINT AS n FROM l GROUP BY conv_id""")
def table_lengths(spark, sf_dir):
    return _tables(spark, sf_dir).select("conv_id", korean.table_length(F.col("t")).alias("n"))


@query(rf"""WITH t AS ({_TABLES}), l AS (SELECT conv_id, unnest(string_split(t, chr(10))) AS l, unnest(generate_series(1, len(string_split(t, chr(10))))) AS i FROM t),
f AS (SELECT conv_id, i, trim(regexp_extract(l, '^\s*[-*]?\s*`?status`?\s*:(.*)$', 1, 'i')) AS v FROM l)
SELECT t.conv_id, coalesce((SELECT arg_min(v, i) FROM f WHERE f.conv_id = t.conv_id AND lower(v) NOT IN ('', 'n/a', 'na', 'none', 'null', 'undecided', '미정')), '') AS status FROM t""")
def first_field(spark, sf_dir):
    return _tables(spark, sf_dir).select("conv_id", korean.field(F.col("t"), ("status",)).alias("status"))


_KOREAN = "SELECT doc_id, (['신문처럼 쓴 보고서로', '친구에게 같은 문서', 'Report형 하게끔 글', '으로 로'])[(doc_id % 4 + 1)::INTEGER] || ' ' || coalesce(text, '') AS q FROM documents"


_BARE = "x"
for _e in korean.ENDINGS:
    _BARE = f"regexp_replace({_BARE}, '^(.{{2,}}){_e}$', '\\1')"


@query(f"""WITH k AS ({_KOREAN}) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_distinct(regexp_extract_all(lower(q), '[0-9a-z가-힣]+')), lambda x: {_BARE}), lambda x: length(x) >= 2))), ' ') AS tokens FROM k""")
def korean_tokens(spark, sf_dir):
    heads = ("신문처럼 쓴 보고서로", "친구에게 같은 문서", "Report형 하게끔 글", "으로 로")
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 4 + 1).cast("int"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.lit(" "), F.coalesce("text", F.lit(""))).alias("q"))
    return d.select("doc_id", F.array_join(F.array_sort(korean.cue_tokens(F.col("q"))), " ").alias("tokens"))


@query()
def compatible_texts(spark, sf_dir):
    """Texts after NFKC without white space, as length and digest."""
    t = korean.compatible(read(spark, sf_dir, "documents").select("doc_id", F.col("text")), "doc_id", "text")
    return t.select("doc_id", F.length("plain").cast("long").alias("n"), F.sha2("plain", 256).alias("digest"))


@query(r"""WITH d AS (SELECT page_id, regexp_replace(coalesce(html, '') || '<h2>A ' || page_id || '</h2>short<!-- c --><h3></h3>x<H2 id="b">B</H2>' || repeat('y ', 200), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
s AS (SELECT page_id, regexp_extract_all(h, '(?is)<h[23]\b[^>]*>.*?</h[23]>') AS heads, regexp_split_to_array(h, '(?is)<h[23]\b[^>]*>.*?</h[23]>') AS bodies FROM d),
x AS (SELECT page_id, unnest(generate_series(1, len(heads))) AS i, heads, bodies FROM s),
y AS (SELECT page_id, i, trim(regexp_replace(regexp_replace(heads[i], '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS heading, length(trim(regexp_replace(regexp_replace(bodies[i + 1], '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS n FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS r FROM y WHERE heading <> '' AND n < 260)
SELECT page_id, heading, n::INTEGER AS n FROM z WHERE r <= 12""")
def thin_sections(spark, sf_dir):
    h = F.concat(F.coalesce("html", F.lit("")), F.lit("<h2>A "), F.col("page_id").cast("string"), F.lit('</h2>short<!-- c --><h3></h3>x<H2 id="b">B</H2>' + "y " * 200))
    p = read(spark, sf_dir, "pages").filter("page_id is not null").select("page_id", F.explode(korean.thin_sections(h)).alias("s"))
    return p.select("page_id", "s.heading", "s.n")


@query(r"""WITH p AS (SELECT page_id, coalesce(html, '') || '&#x1F;&#65;&#' || page_id || ';&#xD800;' AS h FROM pages),
r AS (SELECT page_id, unnest(regexp_extract_all(h, '&#(x[0-9A-Fa-f]+|[0-9]+);', 1)) AS v FROM p),
n AS (SELECT page_id, CASE WHEN starts_with(v, 'x') THEN ('0x' || substr(v, 2))::BIGINT ELSE v::BIGINT END AS c FROM r)
SELECT page_id, count(*) FILTER (NOT (c IN (9, 10, 13) OR c BETWEEN 32 AND 55295 OR c BETWEEN 57344 AND 65533 OR c BETWEEN 65536 AND 1114111)) AS repaired FROM n GROUP BY page_id""")
def repaired_references(spark, sf_dir):
    h = F.concat(F.coalesce("html", F.lit("")), F.lit("&#x1F;&#65;&#"), F.col("page_id").cast("string"), F.lit(";&#xD800;"))
    return read(spark, sf_dir, "pages").filter("page_id is not null").select("page_id", korean.bad_references(h).alias("repaired"))


# Shapes, counters and rules


@query("""WITH s AS (SELECT l_orderkey, sum(l_quantity::DOUBLE) AS dx, sum(l_linenumber)::DOUBLE AS dy, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n, least(greatest(10 * pow(2, least(n, 3)) + 0, 0), 60) AS w, round_even(least(dx, 100), 2) AS x, dy AS y FROM s""")
def shape_boxes(spark, sf_dir):
    """Moves and doublings composed in order, then clamped to a parent box of 100 by 1000, 60 wide at most."""
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("double")).alias("e"), F.sum(F.col("l_linenumber").cast("double")).alias("f"))
    scale = F.pow(F.lit(2.0), F.least("n", F.lit(3)))
    return g.select("l_orderkey", "n", F.least(scale * 10, F.lit(60.0)).alias("w"), F.bround(F.least("e", F.lit(100.0)), 2).alias("x"), F.col("f").alias("y"))


@query("""SELECT count(*) AS documents, count(*) FILTER (text IS NULL) AS without_text, count(DISTINCT source) AS sources, count(*) FILTER (n_chars >= 10000) AS large,
sum((l.doc_id IS NOT NULL)::INTEGER)::BIGINT AS labelled, sum((l.toxic = 1)::INTEGER)::BIGINT AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def corpus_counters(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(1).alias("_l"))
    d = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return d.agg(F.count("*").alias("documents"), F.count_if(F.col("text").isNull()).alias("without_text"), F.count_distinct("source").alias("sources"), F.count_if(F.col("n_chars") >= 10000).alias("large"), F.count_if(F.col("_l") == 1).alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("""SELECT l_orderkey, sum(l_quantity + l_linenumber)::DOUBLE AS margins, max(l_quantity)::DOUBLE AS widest FROM lineitem GROUP BY l_orderkey""")
def geometry_sums(spark, sf_dir):
    left, right = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(left + right).alias("margins"), F.max(left).alias("widest"))


@query("""SELECT page_id, """ + ", ".join(f"len(regexp_extract_all(coalesce(html, ''), '(?i)<{t}[\\s>]')) > 0 AS has_{t}" for t in ("a", "p", "table", "figure", "img", "h1", "h2")) + " FROM pages")
def feature_flags(spark, sf_dir):
    from strata.operators import html

    return read(spark, sf_dir, "pages").select("page_id", *[(html.tag_count(F.col("html"), t) > 0).alias(f"has_{t}") for t in ("a", "p", "table", "figure", "img", "h1", "h2")])


_RULES = [("quantity", "max_a", "max_b", "high"), ("rows", "n_a", "n_b", "high"), ("lines", "line_a", "line_b", "low")]


@query("""WITH s AS (SELECT l_suppkey % 20 AS k, count(*) FILTER (l_linenumber <= 3) AS n_a, count(*) FILTER (l_linenumber > 3) AS n_b, max(l_quantity) FILTER (l_linenumber <= 3)::BIGINT AS max_a, max(l_quantity) FILTER (l_linenumber > 3)::BIGINT AS max_b,
max(l_linenumber) FILTER (l_quantity < 2)::BIGINT AS line_a, max(l_linenumber) FILTER (l_quantity > 49)::BIGINT AS line_b FROM lineitem GROUP BY 1),
p AS (SELECT 'quantity' AS rule, max_a AS a, max_b AS b FROM s UNION ALL SELECT 'rows', n_a, n_b FROM s UNION ALL SELECT 'lines', line_a, line_b FROM s),
r AS (SELECT rule, CASE WHEN a IS NULL OR b IS NULL THEN 'missing_signal' WHEN a = b THEN 'exact' WHEN a > 0 AND b > 0 THEN CASE WHEN abs(a - b) <= greatest(2, round_even(greatest(a, b) * 0.05, 0)) THEN 'close' ELSE 'both_present' END ELSE 'one' END AS r FROM p),
g AS (SELECT rule, count(*) FILTER (r = 'exact') AS exact, count(*) FILTER (r = 'close') AS close, count(*) FILTER (r = 'both_present') AS both_present, count(*) FILTER (r <> 'missing_signal') AS compared FROM r GROUP BY rule),
h AS (SELECT *, coalesce(round_even((exact + close * 0.7::DOUBLE + both_present * 0.4::DOUBLE) / nullif(compared, 0), 4), 0) AS confidence FROM g)
SELECT *, CASE WHEN confidence >= 0.95 THEN 'high_confidence' WHEN confidence >= 0.75 THEN 'medium_confidence' WHEN confidence >= 0.45 THEN 'weak_signal' ELSE 'exploratory' END AS band FROM h""")
def mined_rules(spark, sf_dir):
    """Declared rules over pairs of signals, as one long table and one aggregate."""
    early, q, n = F.col("l_linenumber") <= 3, F.col("l_quantity"), F.col("l_linenumber")
    s = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("k")).agg(
        F.count_if(early).alias("n_a"), F.count_if(~early).alias("n_b"), F.max(F.when(early, q)).cast("long").alias("max_a"), F.max(F.when(~early, q)).cast("long").alias("max_b"),
        F.max(F.when(q < 2, n)).cast("long").alias("line_a"), F.max(F.when(q > 49, n)).cast("long").alias("line_b"))
    return rules.confidence(rules.signals(s, _RULES), "rule", "a", "b")


# Sinks and state


def _folder(spark) -> str:
    return f"{sinks.shared_folder(spark)}/strata-sinks/{uuid.uuid4().hex}"


@query(r"""SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, regexp_replace(coalesce(text, ''), '[\t\r\n]+', ' ', 'g') AS text FROM conversations""")
def tsv_round_trip(spark, sf_dir):
    path = _folder(spark)
    sinks.write_tsv(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), path)
    return sinks.read_tsv(spark, path, ["conv_id", "turn", "text"])


@query("SELECT item_id, text FROM benchmark")
def json_round_trip(spark, sf_dir):
    path, b = _folder(spark), read(spark, sf_dir, "benchmark").select("item_id", "text")
    sinks.write_json(b, path)
    return spark.read.schema(b.schema).json(path)


@query("SELECT n_nationkey, '<table><tr><th>n_nationkey</th><td>' || n_nationkey || '</td></tr><tr><th>n_name</th><td>' || n_name || '&lt;&amp;&gt;</td></tr></table>' AS html FROM nation")
def html_panels(spark, sf_dir):
    return sinks.panel(read(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("<&>")).alias("n_name")), "n_nationkey")


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, coalesce(CASE WHEN s_suppkey % 5 <> 0 THEN s_name END, '') AS s_name FROM supplier")
def text_table(spark, sf_dir):
    return sinks.as_text(read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("s_name")))


@query("SELECT 'supplier' AS name, count(*) AS rows_before, count(*) FILTER (s_suppkey % 9 <> 0) AS rows_after, true AS changed FROM supplier UNION ALL SELECT 'nation', count(*), count(*), false FROM nation")
def replacements(spark, sf_dir):
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return sinks.replacement(s, s.filter("s_suppkey % 9 <> 0"), "supplier").union(sinks.replacement(n, n.repartition(3), "nation"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 1000, r_name, NULL FROM region")
def appended_rows(spark, sf_dir):
    r = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit("x").alias("other"))
    return sinks.appended(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), r)


@query("""WITH e AS (SELECT DISTINCT event_type AS preset, (['draft', 'review', 'final'])[(event_id % 3 + 1)::INTEGER] AS stage, CASE WHEN event_id % 2 = 0 THEN 'ko' ELSE '' END AS lang FROM events)
SELECT a.preset, a.stage, CASE WHEN b.preset IS NOT NULL THEN 'ko' WHEN c.preset IS NOT NULL THEN '' END AS lang FROM (SELECT DISTINCT preset, stage FROM e) a
LEFT JOIN e b ON b.preset = a.preset AND b.stage = a.stage AND b.lang = 'ko' LEFT JOIN e c ON c.preset = a.preset AND c.stage = a.stage AND c.lang = ''""")
def staged_assets(spark, sf_dir):
    """The asset of each preset and stage in the wanted language, else the one without a language."""
    i = F.col("event_id")
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("preset"), F.element_at(F.array(*map(F.lit, ("draft", "review", "final"))), (i % 3 + 1).cast("int")).alias("stage"), F.when(i % 2 == 0, "ko").otherwise("").alias("lang"))
    wanted = F.max(F.when(F.col("lang") == "ko", "ko"))
    return e.groupBy("preset", "stage").agg(F.coalesce(wanted, F.max(F.when(F.col("lang") == "", ""))).alias("lang"))
