"""Queries on single records, links, ordered rows, nested values, scores and routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import blocks, evidence, linking, nested, ordering, registers, route, rules
from strata.plans.registry import query, read

# Predicates and scalar functions


@query(rf"""SELECT doc_id, length(c) AS compact, length(c) < 80 OR regexp_full_match(c, '(?i)({"|".join(T.PORTAL_PAGES)})') AS thin
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents)""")
def thin_text(spark, sf_dir):
    c = T.collapsed(F.col("text"))
    d = read(spark, sf_dir, "documents").select("doc_id", c.alias("c"))
    return d.select("doc_id", F.length("c").cast("long").alias("compact"), ((F.length("c") < 80) | T.portal_page(F.col("c"))).alias("thin"))


_LINE = r"(^|[^A-Za-z0-9])[A-Za-z]:[\\/]|[0-9A-Za-z_.]+@[0-9A-Za-z_.]+"


@query(f"""SELECT doc_id, line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no FROM documents)
WHERE regexp_matches(line, '{_LINE}')""")
def line_scan(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.filter(F.col("line").rlike(_LINE)).select("doc_id", (F.col("p") + 1).alias("line_no"))


@query(r"""SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN regexp_matches(text, '(?i)(api[_-]?key|password|secret)') THEN 'secret' WHEN regexp_matches(text, '[0-9A-Za-z_.]+@[0-9A-Za-z_.]+') THEN 'contact'
WHEN length(text) < 40 THEN 'short' ELSE 'allowed' END AS outcome FROM documents""")
def export_allowed(spark, sf_dir):
    t = F.col("text")
    outcome = F.when(t.isNull(), "missing").when(t.rlike(r"(?i)(api[_-]?key|password|secret)"), "secret").when(t.rlike(r"[0-9A-Za-z_.]+@[0-9A-Za-z_.]+"), "contact").when(F.length(t) < 40, "short").otherwise("allowed")
    return read(spark, sf_dir, "documents").select("doc_id", outcome.alias("outcome"))


@query(r"""SELECT page_id, coalesce(try_cast(regexp_extract(url, '[?&]page=([^&#]*)', 1) AS INTEGER), 0) AS page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) IN ('1', 'x', 'yes') AS referred,
regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, url LIKE 'https:%' AS secure FROM pages""")
def lenient_casts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.to_int(F.regexp_extract("url", r"[?&]page=([^&#]*)", 1)).alias("page"), T.truthy(F.regexp_extract("url", r"[?&]ref=([^&#]*)", 1), ("1", "x", "yes")).alias("referred"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.col("url").startswith("https:").alias("secure"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'priority' END,
CASE WHEN o_totalprice < 20000 THEN 'price' END) AS errors FROM orders""")
def domain_errors(spark, sf_dir):
    checks = [(~F.col("o_orderstatus").isin("F", "O"), "status"), (~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "priority"), (F.col("o_totalprice") < 20000, "price")]
    return read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", *[F.when(c, n) for c, n in checks]).alias("errors"))


@query(r"""SELECT conv_id, turn, contains(t, 'tion') AS mentioned, contains(regexp_replace(t, '(nicht|not|pas|the) [^ \n]*', '', 'g'), 'tion') AS asserted
FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations)""")
def negated_keyword(spark, sf_dir):
    t = F.lower(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.contains(t, F.lit("tion")).alias("mentioned"), F.contains(F.regexp_replace(t, r"(nicht|not|pas|the) [^ \n]*", ""), F.lit("tion")).alias("asserted"))


@query(r"""SELECT item_id, len(list_distinct(w))::INTEGER AS n_tokens, array_to_string(list_sort(list_distinct(w)), ' ') AS tokens FROM
(SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{3,}|[가-힣]{2,}'), lambda x: x NOT IN ('with', 'that', 'this', 'from')) AS w FROM benchmark)""")
def token_sets(spark, sf_dir):
    w = T.tokens(F.lower("text"), ("with", "that", "this", "from"))
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(w).alias("n_tokens"), F.array_join(F.array_sort(w), " ").alias("tokens"))


@query(r"""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{3,}|[가-힣]{2,}')) AS w FROM benchmark)
SELECT a.item_id, len(list_intersect(a.w, b.w))::INTEGER AS shared, round_even(len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, len(a.w)), 4) AS ratio FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def token_overlap(spark, sf_dir):
    t = read(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.lower("text")).alias("w"))
    n = F.size(F.array_intersect("w", "v"))
    j = t.join(t.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v")), "item_id")
    return j.select("item_id", n.alias("shared"), F.bround(n / F.greatest(F.lit(1), F.size("w")), 4).alias("ratio"))


@query(r"""SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{2,} [A-Z][a-z]{2,}')) AS name FROM documents) GROUP BY ALL""")
def named_terms(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{2,} [A-Z][a-z]{2,}"), 0)
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query(r"""SELECT conv_id, turn, line_no, quote FROM (SELECT conv_id, turn, line_no, regexp_replace(line, '^[-*>0-9. \t]+', '') AS quote FROM
(SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no FROM conversations)) WHERE length(quote) >= 18""")
def quote_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.select("conv_id", "turn", (F.col("p") + 1).alias("line_no"), T.quote_line(F.col("line")).alias("quote")).filter(F.length("quote") >= 18)


@query(r"""SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S+09:00') AS stamp, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, json_valid(props) AS parsed FROM events""")
def stamps_and_paths(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", T.stamp(F.col("ts")).alias("stamp"), T.to_int(F.get_json_object("props", "$.k")).alias("k"), F.try_parse_json("props").isNotNull().alias("parsed"))


@query("""SELECT p_partkey, round_even(p_size * 7200 / 25.4::DOUBLE, 2) AS units, '#' || lpad(lower(hex((p_partkey * 7919) % 16777216)), 6, '0') AS colour FROM part""")
def unit_conversion(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.bround(T.from_mm(F.col("p_size")), 2).alias("units"), T.colour(F.col("p_partkey") * 7919 % 16777216).alias("colour"))


# Links


@query("SELECT DISTINCT w AS term FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) t WHERE w <> '' AND NOT EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), t.w))")
def terms_unsupported(spark, sf_dir):
    terms = read(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).filter("term <> ''").distinct()
    texts = read(spark, sf_dir, "documents").select(F.lower("text").alias("text"))
    return evidence.unsupported(terms.withColumn("text", F.col("term")), texts, "term")


@query(r"""WITH r AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id || '.md' ELSE 'rec_' || doc_id || '.md' END AS path, CASE WHEN doc_id % 5 = 1 THEN 'source_id: `' || (doc_id + 7) || '`' || chr(10) || coalesce(text, '') ELSE text END AS text FROM documents),
k AS (SELECT DISTINCT doc_id AS id FROM labels), x AS (SELECT id, min(path) AS p FROM k JOIN r ON path = id || '.md' GROUP BY id),
n AS (SELECT id, min(path) AS p FROM k JOIN r ON contains(regexp_replace(path, '\.md$', ''), id::VARCHAR) OR list_contains(regexp_extract_all(text, '\bsource_id\b\s*:\s*`?(\w+)', 1), id::VARCHAR) WHERE id NOT IN (SELECT id FROM x) GROUP BY id)
SELECT k.id AS doc_id, CASE WHEN x.p IS NOT NULL THEN 'exact' WHEN n.p IS NOT NULL THEN 'named' ELSE 'none' END AS how, coalesce(x.p, n.p) AS path FROM k LEFT JOIN x USING (id) LEFT JOIN n USING (id)""")
def lookup_fallback(spark, sf_dir):
    i = F.col("doc_id")
    named = F.concat(F.lit("source_id: `"), (i + 7).cast("string"), F.lit("`\n"), F.coalesce("text", F.lit("")))
    path = F.concat(F.when(i % 3 == 0, "").otherwise("rec_"), i.cast("string"), F.lit(".md"))
    records = read(spark, sf_dir, "documents").select(path.alias("path"), F.when(i % 5 == 1, named).otherwise(F.col("text")).alias("text"))
    return linking.find_records(read(spark, sf_dir, "labels").select("doc_id"), records, "doc_id", "path", "text")


@query(r"""WITH q AS (SELECT item_id, text FROM benchmark UNION ALL SELECT 100000 + doc_id, text FROM documents),
e AS (SELECT item_id, q.text, s FROM q LEFT JOIN (SELECT text, min(doc_id) AS s FROM documents GROUP BY text) d ON d.text = q.text),
h AS (SELECT item_id, min(doc_id) AS h FROM e JOIN documents d ON contains(d.text, e.text) WHERE s IS NULL GROUP BY item_id)
SELECT item_id, CASE WHEN s IS NOT NULL THEN 'equal' WHEN h IS NOT NULL THEN 'within' ELSE 'none' END AS how, coalesce(s, h) AS place FROM e LEFT JOIN h USING (item_id)""")
def lookup_every(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    q = read(spark, sf_dir, "benchmark").select("item_id", "text").union(d.select(F.col("doc_id") + 100000, "text"))
    shingles = T.shingles(F.col("text"), 3)
    anchor = F.when(F.size(shingles) >= 3, shingles[1])
    return linking.first_holder(q, d, "item_id", "text", "doc_id", "text", anchor, shingles, unanchored=True)


@query("""SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 48) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY l_returnflag""")
def either_key(spark, sf_dir):
    parts = read(spark, sf_dir, "part").filter("p_size > 48").select("p_partkey")
    suppliers = read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select("s_suppkey")
    found = linking.either_key(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey"), [("l_partkey", parts), ("l_suppkey", suppliers)])
    return found.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND lang <> 'en'")
def citable(spark, sf_dir):
    good = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", "lang").filter("lang <> 'en'").join(good, "doc_id", "left_semi")


@query("""WITH a AS (SELECT lower(p_name) AS stem, min(p_partkey) AS l FROM part WHERE p_size < 10 GROUP BY 1), b AS (SELECT lower(p_name) AS stem, min(p_partkey) AS r FROM part WHERE p_size > 40 GROUP BY 1)
SELECT stem, l AS left, r AS right, p_brand AS baseline FROM a JOIN b USING (stem) LEFT JOIN part ON p_partkey = l AND p_type = 'ECONOMY'""")
def stem_pairs(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("stem", F.lower("p_name"))
    pairs = linking.stem_pairs(p.filter("p_size < 10"), p.filter("p_size > 40"), "stem", "p_partkey")
    base = p.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("left"), F.col("p_brand").alias("baseline"))
    return pairs.join(base, "left", "left").select("stem", "left", "right", "baseline")


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE upper(md5(coalesce(text, ''))) END AS h FROM documents), c AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id, CASE WHEN c.doc_id IS NULL THEN 'missing' WHEN lower(r.h) = lower(c.h) THEN 'fresh' ELSE 'stale' END AS state FROM r LEFT JOIN c USING (doc_id)""")
def hash_freshness(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    recorded = d.withColumn("h", F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.upper("h")))
    return linking.freshness(recorded, d.filter("doc_id % 7 <> 0"), "doc_id", "h")


@query("""SELECT c_custkey, coalesce(n_name, 'plan ' || c_mktsegment) AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON n_nationkey = c_nationkey""")
def plan_labels(spark, sf_dir):
    n = read(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read(spark, sf_dir, "customer").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.concat(F.lit("plan "), "c_mktsegment")).alias("label"))


@query("""WITH a AS (SELECT conv_id, turn, role FROM conversations), b AS (SELECT conv_id - 1 AS conv_id, turn, role FROM conversations)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, bool_and(a.role IS NOT NULL AND b.role IS NOT NULL AND a.role = b.role) AS passed, count(*) AS places FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn GROUP BY 1""")
def zip_turns(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    z = linking.by_position(c, c.withColumn("conv_id", F.col("conv_id") - 1), "conv_id", "turn", "role")
    return z.groupBy("conv_id").agg(F.bool_and("same").alias("passed"), F.count("*").alias("places"))


@query("""SELECT 'duplicate' AS fault, conv_id AS key, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1
UNION ALL SELECT 'dangling', page_id, count(*) FROM pages WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id IS NOT NULL) GROUP BY page_id""")
def reference_faults(spark, sf_dir):
    return linking.reference_faults(read(spark, sf_dir, "conversations"), "conv_id", read(spark, sf_dir, "pages"), "page_id")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS node, s_suppkey // 2 AS ancestor FROM supplier WHERE s_suppkey // 2 > 0), t AS (SELECT node, ancestor, 1 AS depth FROM e UNION ALL SELECT t.node, e.ancestor, t.depth + 1 FROM t JOIN e ON e.node = t.ancestor)
SELECT node, ancestor, depth FROM t""")
def closure(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.expr("nullif(s_suppkey div 2, 0)").alias("up"))
    return linking.closure(s, "s_suppkey", "up")


@query("""WITH e AS (SELECT user_id, event_id, 1 + event_id % 4 AS level FROM events)
SELECT event_id, (SELECT max(p.event_id) FROM e p WHERE p.user_id = e.user_id AND p.event_id < e.event_id AND p.level < e.level) AS parent FROM e""")
def heading_parent(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (1 + F.col("event_id") % 4).alias("level"))
    return ordering.parents(e, "user_id", "event_id", "level", 4).select("event_id", "parent")


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click')")
def except_known(spark, sf_dir):
    known = spark.createDataFrame([("view",), ("click",)], "event_type string")
    return read(spark, sf_dir, "events").select("event_type").subtract(known)


# Ordered rows


@query("SELECT source, doc_id, n_chars, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, max(n_chars) OVER (PARTITION BY source) AS top FROM documents) WHERE r <= 3 AND n_chars >= top - 2000")
def margin_set(spark, sf_dir):
    return ordering.within_margin(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", 3, 2000)


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'balance' WHEN c_mktsegment LIKE 'B%' THEN 'segment' WHEN trim(c_name) <> '' THEN 'name' END AS origin,
CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_mktsegment LIKE 'B%' THEN c_mktsegment WHEN trim(c_name) <> '' THEN c_name END AS value FROM customer""")
def preferred_value(spark, sf_dir):
    return ordering.prefer(read(spark, sf_dir, "customer"), "c_custkey", [("balance", F.when(F.col("c_acctbal") > 5000, "rich")), ("segment", F.when(F.col("c_mktsegment").startswith("B"), F.col("c_mktsegment"))), ("name", F.col("c_name"))])


@query("SELECT conv_id, turn, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM conversations")
def turn_positions(spark, sf_dir):
    return ordering.positions(read(spark, sf_dir, "conversations"), "conv_id", "turn", F.length(F.coalesce("text", F.lit("")))).select("conv_id", "turn", "begins")


@query("SELECT doc_id, source, r AS seq FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def sequence_ids(spark, sf_dir):
    return linking.numbered(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), "doc_id", "source", "doc_id")


@query("SELECT s_suppkey, CASE WHEN top > 5000 THEN round_even(s_acctbal * 5000 / top, 0) ELSE s_acctbal END AS scaled FROM (SELECT *, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS top FROM supplier)")
def rescaled(spark, sf_dir):
    return ordering.rescale(read(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal", 5000.0).select("s_suppkey", "scaled")


@query("SELECT p_partkey, ((row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) % 7)::INTEGER AS slot FROM part")
def even_slots(spark, sf_dir):
    return ordering.round_robin(read(spark, sf_dir, "part"), "p_type", "p_partkey", 7).select("p_partkey", "slot")


@query("SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000000) AS ends FROM events")
def slices(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.lit(1000000000).cast("long").alias("whole"))
    return ordering.spans(e, "user_id", "event_id", "whole").select("event_id", F.col("end").alias("ends"))


@query("""SELECT event_id, last_value(v IGNORE NULLS) OVER w AS carried, sum((event_type = 'signup')::INTEGER) OVER w AS scope FROM (SELECT *, CASE WHEN event_type = 'view' THEN value END AS v FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_and_scope(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "view", F.col("value")).alias("carried"))
    return ordering.scopes(ordering.forward_fill(e, "user_id", "event_id", "carried"), "user_id", "event_id", F.col("event_type") == "signup").select("event_id", "carried", "scope")


@query("""SELECT conv_id, array_to_string(list(role ORDER BY turn)[1:4] || list_resize(CAST([] AS VARCHAR[]), greatest(0, 4 - count(*))::BIGINT, 'none'), ',') AS roles FROM conversations GROUP BY conv_id""")
def padded_roles(spark, sf_dir):
    return ordering.padded(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", 4, "none").select("conv_id", F.array_join("items", ",").alias("roles"))


# Aggregates and nested values


@query("""SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role <> 'user') AS n_other, sum(length(text))::BIGINT AS chars, sha256(string_agg(text, chr(10) ORDER BY turn)) AS lines_digest, sha256(string_agg(text, ' ' ORDER BY turn)) AS words_digest
FROM conversations GROUP BY conv_id""")
def block_digest(spark, sf_dir):
    joined = lambda sep: F.expr(f"listagg(text, '{sep}') WITHIN GROUP (ORDER BY turn)")
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") != "user").alias("n_other"), F.sum(F.length("text")).alias("chars"), joined("\\n").alias("_l"), joined(" ").alias("_w"))
    return c.select("conv_id", "n_user", "n_other", "chars", F.sha2("_l", 256).alias("lines_digest"), F.sha2("_w", 256).alias("words_digest"))


@query("""SELECT event_type, sum(n)::BIGINT AS n, sum(users)::BIGINT AS user_days, max(top) AS top FROM (SELECT event_type, ts::DATE AS d, count(*) AS n, count(DISTINCT user_id) AS users, max(value) AS top FROM events GROUP BY 1, 2) GROUP BY event_type""")
def two_level_counts(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("value").alias("top"))
    return days.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("users").alias("user_days"), F.max("top").alias("top"))


@query("""WITH a AS (SELECT * FROM customer), b AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 5 <> 0),
j AS (SELECT a.*, b.c_custkey AS k, b.c_mktsegment AS m FROM a LEFT JOIN b USING (c_custkey))
SELECT '$.name' AS path, count(*) AS total, count(k) AS exact FROM j UNION ALL SELECT '$.at.nation', count(*), count(k) FROM j
UNION ALL SELECT '$.at.tags[]', 2 * count(*), count(k) + count(*) FILTER (m = c_mktsegment) FROM j""")
def leaf_compare(spark, sf_dir):
    def shape(df, segment):
        at = F.struct(F.col("c_nationkey").alias("nation"), F.array(F.lit("tag"), segment).alias("tags"))
        return nested.leaves(df.select("c_custkey", F.struct(F.col("c_name").alias("name"), at.alias("at")).alias("v")), "c_custkey", "v")

    c = read(spark, sf_dir, "customer")
    other = F.when(F.col("c_custkey") % 3 == 0, "other").otherwise(F.col("c_mktsegment"))
    return nested.compare(shape(c, F.col("c_mktsegment")), shape(c.filter("c_custkey % 5 <> 0"), other), "c_custkey")


@query("""SELECT s_suppkey, sha256('{"name":"' || s_name || '","nation":' || s_nationkey || '}') AS digest FROM supplier""")
def field_digest(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", nested.digest({"nation": F.col("s_nationkey"), "name": F.col("s_name")}).alias("digest"))


@query("""SELECT o_orderkey, sha256(to_json({'customer': {'key': o_custkey, 'name': c_name}, 'lines': list({'part': l_partkey, 'quantity': l_linenumber} ORDER BY l_linenumber, l_partkey)})) AS digest
FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_orderkey, o_custkey, c_name""")
def nested_digest(spark, sf_dir):
    """Orders as nested records whose fields stand in another order than that of their names."""
    line = F.struct(F.col("l_linenumber").alias("quantity"), F.col("l_partkey").alias("part"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    o = o.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    o = o.select("o_orderkey", F.struct("lines", F.struct(F.col("c_name").alias("name"), F.col("o_custkey").alias("key")).alias("customer")).alias("record"))
    return o.select("o_orderkey", nested.record_digest(o, "record").alias("digest"))


@query("""SELECT user_id, max(ts) FILTER (event_type = 'click') AS newest_input, min(ts) FILTER (event_type = 'purchase') AS oldest_output,
coalesce(max(ts) FILTER (event_type = 'click') <= min(ts) FILTER (event_type = 'purchase'), false) AS fresh FROM events GROUP BY user_id""")
def staleness(spark, sf_dir):
    at = lambda t: F.when(F.col("event_type") == t, F.col("ts"))
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max(at("click")).alias("newest_input"), F.min(at("purchase")).alias("oldest_output"))
    return e.withColumn("fresh", F.coalesce(F.col("newest_input") <= F.col("oldest_output"), F.lit(False)))


@query("""SELECT l_suppkey, bool_and(l_quantity <= 50 AND l_discount <= 0.1) AS passed, bool_and(l_quantity <= 49) AS quantity, bool_and(l_tax <= 0.08) AS tax FROM lineitem GROUP BY l_suppkey""")
def component_check(spark, sf_dir):
    q = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.bool_and((q <= 50) & (F.col("l_discount") <= 0.1)).alias("passed"), F.bool_and(q <= 49).alias("quantity"), F.bool_and(F.col("l_tax") <= 0.08).alias("tax"))


# Rules, scores and routes


@query("""WITH j AS (SELECT d.doc_id, d.text, d.n_chars, l.doc_id AS k, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, 'error' AS severity, 'toxic' AS rule FROM j WHERE toxic = 1 UNION ALL SELECT doc_id, 'warning', 'unlabelled' FROM j WHERE k IS NULL
UNION ALL SELECT doc_id, 'warning', 'weak' FROM j WHERE quality = 0 UNION ALL SELECT doc_id, 'error', 'short' FROM j WHERE n_chars < 100""")
def row_rules(spark, sf_dir):
    j = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels").withColumn("_k", F.lit(True)), "doc_id", "left")
    checks = [("error", "toxic", F.col("toxic") == 1), ("warning", "unlabelled", F.col("_k").isNull()), ("warning", "weak", F.col("quality") == 0), ("error", "short", F.col("n_chars") < 100)]
    return rules.findings(j, "doc_id", checks)


@query("""WITH f AS (SELECT source, count(*) AS n, count(l.doc_id) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad, count(*) FILTER (n_chars < 100) AS short FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source),
s AS (SELECT source, least(n, 40) AS volume, least(labelled, 30) AS labels, least(2 * good, 30) AS quality, least(60, 5 * bad + short) AS deducted, n < 20 AS blocked FROM f),
t AS (SELECT *, greatest(0, least(100, volume + labels + quality - deducted)) AS raw FROM s)
SELECT source, volume, labels, quality, deducted, blocked, CASE WHEN blocked THEN least(59, raw) ELSE raw END AS total, least(5, (CASE WHEN blocked THEN least(59, raw) ELSE raw END) // 20)::INTEGER AS level FROM t""")
def scorecard(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels").withColumn("_k", F.lit(1)), "doc_id", "left")
    f = d.groupBy("source").agg(F.count("*").alias("n"), F.count("_k").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("n_chars") < 100).alias("short"))
    parts = {"volume": (F.col("n"), 40), "labels": (F.col("labelled"), 30), "quality": (2 * F.col("good"), 30)}
    return rules.scorecard(f, "source", parts, [5 * F.col("bad"), F.col("short")], F.col("n") < 20)


@query("""SELECT doc_id, CASE WHEN coalesce(n_chars < 100, true) THEN 'length' WHEN coalesce(lang <> 'en', true) THEN 'language' WHEN NOT coalesce(contains(text, '.'), false) THEN 'sentences' END AS failed,
CASE WHEN coalesce(n_chars < 100, true) THEN 0 WHEN coalesce(lang <> 'en', true) THEN 1 WHEN NOT coalesce(contains(text, '.'), false) THEN 2 ELSE 3 END AS passed FROM documents""")
def first_failure(spark, sf_dir):
    checks = [("length", F.col("n_chars") >= 100), ("language", F.col("lang") == "en"), ("sentences", F.contains("text", F.lit(".")))]
    return rules.first_failure(read(spark, sf_dir, "documents"), "doc_id", checks)


@query("""WITH m(i, marker) AS (VALUES (0, 'the'), (1, 'und'), (2, 'que'), (3, 'tion'))
SELECT doc_id, coalesce((SELECT string_agg(marker, ',' ORDER BY i) FROM m WHERE NOT contains(lower(coalesce(text, '')), marker)), '') AS missing, length(coalesce(text, '')) < 900 AS short FROM documents""")
def missing_markers(spark, sf_dir):
    t = F.lower(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", *[F.when(~F.contains(t, F.lit(m)), m) for m in ("the", "und", "que", "tion")]).alias("missing"), (F.length(F.coalesce("text", F.lit(""))) < 900).alias("short"))


_STAGES = "['P', 'O', 'F']"


@query(f"""SELECT o_orderstatus, CASE WHEN bad > 0 THEN 'has_failures' WHEN open > 0 THEN 'incomplete' WHEN review > 0 THEN 'needs_review' ELSE 'pass' END AS state, list_position({_STAGES}, o_orderstatus) >= 2 AS reached
FROM (SELECT o_orderstatus, count(*) FILTER (o_totalprice < 0) AS bad, count(*) FILTER (o_orderstatus = 'P') AS open, count(*) FILTER (o_orderpriority = '1-URGENT') AS review FROM orders GROUP BY 1)""")
def package_state(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") < 0).alias("bad"), F.count_if(F.col("o_orderstatus") == "P").alias("open"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("review"))
    state = F.when(F.col("bad") > 0, "has_failures").when(F.col("open") > 0, "incomplete").when(F.col("review") > 0, "needs_review").otherwise("pass")
    return o.select("o_orderstatus", state.alias("state"), (F.array_position(F.array(*map(F.lit, "POF")), F.col("o_orderstatus")) >= 2).alias("reached"))


@query("""SELECT alias, count(DISTINCT owner) AS owners FROM (SELECT p_name AS alias, p_brand AS owner FROM part) GROUP BY alias HAVING count(DISTINCT owner) > 1""")
def alias_collisions(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("alias")).agg(F.count_distinct("p_brand").alias("owners")).filter("owners > 1")


_ALIASES = [("hold", "Bolt", "held"), ("alias", "red widget", "red"), ("alias", "widget", "widgets"), ("alias", "large blue-ring of steel", "blue"), ("alias", "ring", "rings"), ("alias", "gear", "gears")]
_ALIAS_ROWS = ", ".join(f"({i}, '{k}', '{a.lower().replace(' ', '').replace('-', '')}', '{t}')" for i, (k, a, t) in enumerate(_ALIASES))


@query(f"""WITH a(i, kind, alias, target) AS (VALUES {_ALIAS_ROWS}), q AS (SELECT DISTINCT p_name AS query, regexp_replace(lower(p_name), '[ _-]+', '', 'g') AS n FROM part),
h AS (SELECT query, i, alias, target, CASE WHEN n = '' THEN NULL WHEN kind = 'hold' THEN CASE WHEN contains(n, alias) OR contains(alias, n) THEN 0 END WHEN n = alias THEN 1 WHEN contains(alias, n) THEN 2 WHEN length(alias) >= 4 AND contains(n, alias) THEN 3 END AS tier FROM q, a),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, CASE WHEN tier = 3 THEN -length(alias) ELSE 0 END, i) AS n FROM h WHERE tier IS NOT NULL)
SELECT q.query, target, tier FROM q LEFT JOIN (SELECT * FROM r WHERE r.n = 1) r ON r.query = q.query""")
def alias_router(spark, sf_dir):
    q = read(spark, sf_dir, "part").select(F.col("p_name").alias("query")).distinct()
    return route.by_alias(q, "query", _ALIASES)


# State


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE upper(c_name) END, ''), c_name) AS c_name FROM customer""")
def keep_old_when_blank(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    delta = c.withColumn("c_name", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.upper("c_name")))
    return registers.upsert(c, delta.withColumn("c_name", F.nullif("c_name", F.lit(""))), "c_custkey")


@query("SELECT user_id, count(*) AS versions, arg_max(event_id, (ts, event_id)) AS current FROM events GROUP BY user_id")
def current_pointer(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("versions"), F.max_by("event_id", F.struct("ts", "event_id")).alias("current"))


@query("SELECT d.doc_id, md5(coalesce(text, '')) AS digest FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)")
def pruned_manifest(spark, sf_dir):
    kept = read(spark, sf_dir, "labels").select("doc_id")
    return read(spark, sf_dir, "documents").join(kept, "doc_id", "left_semi").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


# Pages as blocks


@query()
def html_blocks(spark, sf_dir):
    return blocks.html_blocks(read(spark, sf_dir, "pages"))


@query()
def html_parsed(spark, sf_dir):
    return blocks.html_parsed(read(spark, sf_dir, "pages"))
