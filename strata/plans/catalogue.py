"""Queries over the supplied tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import evidence, html, registers, route, rules, units
from strata.plans import documents, drafting, formats, handling, layouts, projects, records, rulebook, sources, stages, stores
from strata.plans.registry import oracle_sql, queries, query, read
from strata.streaming import sessions

__all__ = ["documents", "drafting", "formats", "handling", "layouts", "oracle_sql", "projects", "queries", "read", "records", "rulebook", "sources", "stages", "stores"]

_UNITS = r"""
body AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, t, 0 AS a, 0 AS e FROM body UNION ALL
  SELECT doc_id, t, e AS a, CASE WHEN length(t) - e <= 4000 THEN length(t) WHEN length(regexp_extract(substr(t, e + 802, 3199), '(?s)^(.*)\n\n', 0)) > 0
    THEN e + 801 + length(regexp_extract(substr(t, e + 802, 3199), '(?s)^(.*)\n\n', 1)) ELSE e + 4000 END FROM cut WHERE e < length(t)),
pieces AS (SELECT doc_id, a, regexp_replace(substr(t, a + 1, e - a), '^\s+|\s+$', '', 'g') AS unit_text FROM cut WHERE e > a),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a)::INTEGER AS unit_no, unit_text FROM pieces WHERE unit_text <> '')
"""


@query(f"WITH RECURSIVE {_UNITS} SELECT doc_id, unit_no, unit_text FROM units WHERE unit_text <> ''")
def unit_chunks(spark, sf_dir):
    return units.chunk(read(spark, sf_dir, "documents"))


@query(f"WITH RECURSIVE {_UNITS} SELECT doc_id, count(*) AS n_units, sum(greatest(1, length(unit_text) // 4))::BIGINT AS tokens FROM units WHERE unit_text <> '' GROUP BY doc_id")
def unit_counts(spark, sf_dir):
    u = units.chunk(read(spark, sf_dir, "documents"))
    return u.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum(T.token_estimate(F.col("unit_text"))).alias("tokens"))


@query(f"""WITH RECURSIVE {_UNITS} SELECT doc_id, unit_no, greatest(1, length(unit_text) // 4)::INTEGER AS token_estimate, substr(unit_text, 1, 1200) AS preview
FROM units WHERE unit_text <> '' AND contains(lower(unit_text), 'worthless') ORDER BY token_estimate, doc_id, unit_no LIMIT 8""")
def context_search(spark, sf_dir):
    return units.search(units.chunk(read(spark, sf_dir, "documents")), "worthless")


@query("""SELECT doc_id, sha256(text) AS digest, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS copy,
first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS original FROM documents""")
def exact_duplicates(spark, sf_dir):
    from pyspark.sql import Window

    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    w = Window.partitionBy("digest").orderBy("doc_id")
    return d.select("doc_id", "digest", F.row_number().over(w).alias("copy"), F.first("doc_id").over(w).alias("original"))


@query("SELECT DISTINCT item_id FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def quote_supported(spark, sf_dir):
    return evidence.supported(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def quote_missing(spark, sf_dir):
    return evidence.unsupported(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id")


_PORTAL = "|".join(T.PORTAL_PAGES)
_GENERIC = ", ".join(f"'{w}'" for w in T.GENERIC_QUOTES)


@query(rf"""SELECT conv_id, turn, length(t) < 18 AS short_text, length(t) < 18 OR len(list_distinct(string_split(t, ''))) <= 6 OR t IN ({_GENERIC}) OR regexp_full_match(t, '(?i)({_PORTAL})') AS weak
FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') AS t FROM conversations)""")
def weak_quotes(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    bare = F.regexp_replace(F.regexp_replace(T.collapsed(F.col("text")), '^"+|"+$', ""), "^'+|'+$", "")
    return c.select("conv_id", "turn", (F.length(bare) < 18).alias("short_text"), T.weak_quote(F.col("text")).alias("weak"))


@query(r"""SELECT page_id, regexp_matches(url, '^https?://[^/]+/?(#.*)?$') AS homepage, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin,
regexp_matches(regexp_extract(url, '^(https?://[^/]+)', 1), '^https?://[^/]+/?(#.*)?$') AS origin_is_homepage FROM pages""")
def generic_urls(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("origin", F.regexp_extract("url", "^(https?://[^/]+)", 1))
    return p.select("page_id", T.homepage_url(F.col("url")).alias("homepage"), "origin", T.homepage_url(F.col("origin")).alias("origin_is_homepage"))


@query("SELECT page_id, length(html) AS chars, " + ", ".join(f"len(regexp_extract_all(html, '(?i)<{t}[\\s>]')) AS n_{t}" for t in html.TAGS) + ", regexp_matches(html, '(?i)<title>[^<]+</title>') AS has_title FROM pages")
def html_metrics(spark, sf_dir):
    return html.metrics(read(spark, sf_dir, "pages"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS body FROM pages""")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.stripped(F.col("html")).alias("body"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'brass') OR contains(lower(p_type), 'brass') THEN 'official'
WHEN contains(lower(p_type), 'steel') THEN 'partner' WHEN contains(lower(p_type), 'promo') THEN 'external' ELSE 'unknown' END AS origin,
CASE WHEN p_size < 10 THEN 'tier_1' WHEN p_size < 30 THEN 'tier_2' ELSE 'unsupported' END AS tier FROM part""")
def tier_classify(spark, sf_dir):
    p, has = read(spark, sf_dir, "part"), lambda c, w: F.contains(F.lower(c), F.lit(w))
    origin = F.when(has("p_name", "brass") | has("p_type", "brass"), "official").when(has("p_type", "steel"), "partner").when(has("p_type", "promo"), "external").otherwise("unknown")
    return p.select("p_partkey", origin.alias("origin"), F.when(F.col("p_size") < 10, "tier_1").when(F.col("p_size") < 30, "tier_2").otherwise("unsupported").alias("tier"))


_VISUAL = {"timeline": ("ation", "tion", "jahr"), "process_map": ("ing", "ung"), "comparison": ("der", "the", "ción")}
_SCORES = {k: " + ".join(f"(contains(lower(text), '{w}'))::INTEGER" for w in ws) for k, ws in _VISUAL.items()}


@query("SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'evidence_table' WHEN a >= b AND a >= c THEN 'timeline' WHEN b >= c THEN 'process_map' ELSE 'comparison' END AS visual_type, greatest(a, b, c)::INTEGER AS hits FROM (SELECT doc_id, "
       + ", ".join(f"{v} AS {n}" for n, v in zip("abc", _SCORES.values(), strict=True)) + " FROM documents)")
def visual_type(spark, sf_dir):
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = {k: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0)) for k, ws in _VISUAL.items()}
    best = F.array_max(F.array(*[F.struct(h.alias("n"), F.lit(-i).alias("p"), F.lit(k).alias("t")) for i, (k, h) in enumerate(hits.items())]))
    d = read(spark, sf_dir, "documents").select("doc_id", best.alias("b"))
    return d.select("doc_id", F.when(F.col("b.n") == 0, "evidence_table").otherwise(F.col("b.t")).alias("visual_type"), F.col("b.n").alias("hits"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def register_reconcile(spark, sf_dir):
    return registers.missing_from([read(spark, sf_dir, "documents")], read(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'label_only' WHEN l.doc_id IS NULL THEN 'lead' WHEN l.toxic = 1 THEN 'risk'
WHEN l.quality = 1 THEN 'ok' ELSE 'blocked' END AS state FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id) GROUP BY state""")
def status_panel(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("_d"))
    j = d.join(read(spark, sf_dir, "labels").withColumn("_l", F.lit(True)), "doc_id", "full")
    state = F.when(F.col("_d").isNull(), "label_only").when(F.col("_l").isNull(), "lead").when(F.col("toxic") == 1, "risk").when(F.col("quality") == 1, "ok").otherwise("blocked")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 10 <> 1),
a AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN upper(s_name) || '!' ELSE s_name END AS s_name, s_nationkey, s_acctbal + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS s_acctbal FROM supplier WHERE s_suppkey % 10 <> 2)
SELECT coalesce(b.s_suppkey, a.s_suppkey) AS s_suppkey, CASE WHEN b.s_suppkey IS NULL THEN 'added' WHEN a.s_suppkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
CASE WHEN b.s_suppkey IS NULL OR a.s_suppkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.s_name <> b.s_name THEN 's_name' END, CASE WHEN a.s_acctbal <> b.s_acctbal THEN 's_acctbal' END) END AS columns
FROM b FULL JOIN a ON a.s_suppkey = b.s_suppkey WHERE b.s_suppkey IS NULL OR a.s_suppkey IS NULL OR a.s_name <> b.s_name OR a.s_acctbal <> b.s_acctbal""")
def register_diff(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    k = F.col("s_suppkey")
    after = s.filter(k % 10 != 2).withColumn("s_name", F.when(k % 7 == 0, F.concat(F.upper("s_name"), F.lit("!"))).otherwise(F.col("s_name"))).withColumn("s_acctbal", F.col("s_acctbal") + F.when(k % 5 == 0, 1).otherwise(0))
    return registers.difference(s.filter(k % 10 != 1), after, "s_suppkey")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return registers.last_wins(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_wins(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return registers.first_wins(e, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_changes(spark, sf_dir):
    return sessions.recent(read(spark, sf_dir, "events")).select("event_id", "ts", "user_id", "event_type")


@query("""WITH d AS (SELECT c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 1000000 ELSE 0 END AS c_custkey, c_name || '*' AS c_name, CASE WHEN c_custkey % 8 = 2 THEN NULL ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(d.c_custkey, c.c_custkey) AS c_custkey, coalesce(d.c_name, c.c_name) AS c_name, c.c_nationkey, coalesce(d.c_acctbal, c.c_acctbal) AS c_acctbal, c.c_mktsegment
FROM customer c FULL JOIN d ON c.c_custkey = d.c_custkey""")
def upsert(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    delta = c.filter(k % 2 == 0).select((k + F.when(k % 4 == 0, 1000000).otherwise(0)).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), F.when(k % 8 != 2, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return registers.upsert(c, delta, "c_custkey")


@query("SELECT CASE WHEN n_chars <= 0 THEN 'none' WHEN n_chars < 100 THEN 'small' WHEN n_chars < 1000 THEN 'medium' WHEN n_chars < 10000 THEN 'large' ELSE 'very_large' END AS bucket, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY bucket")
def size_buckets(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(T.count_bucket(F.col("n_chars")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH p AS (SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
x AS (SELECT item_id, c, count(*) AS n FROM (SELECT item_id, unnest(string_split(x, '')) AS c FROM p) GROUP BY ALL),
y AS (SELECT item_id, c, count(*) AS n FROM (SELECT item_id, unnest(string_split(y, '')) AS c FROM p) GROUP BY ALL)
SELECT item_id, sum(least(x.n, y.n))::BIGINT AS shared FROM x JOIN y USING (item_id, c) GROUP BY item_id""")
def char_overlap(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    p = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("y")), "item_id")
    return p.select("item_id", T.size_of_overlap(F.col("text"), F.col("y")).cast("long").alias("shared"))


@query("""SELECT l_suppkey, count(*) AS n FROM (SELECT l_quantity, l_suppkey FROM lineitem WHERE l_linenumber <= 2 INTERSECT ALL
SELECT l_quantity, l_suppkey FROM lineitem WHERE l_linenumber > 2) GROUP BY l_suppkey""")
def bag_overlap(spark, sf_dir):
    li, early = read(spark, sf_dir, "lineitem"), F.col("l_linenumber") <= 2
    return li.filter(early).select("l_quantity", "l_suppkey").intersectAll(li.filter(~early).select("l_quantity", "l_suppkey")).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS a FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, 15 * count(*) AS b FROM supplier GROUP BY 1),
p AS (SELECT n_regionkey, CASE WHEN a IS NULL OR b IS NULL THEN 'missing_signal' WHEN a = b THEN 'exact' WHEN a > 0 AND b > 0 THEN
  CASE WHEN abs(a - b) <= greatest(2, round_even(greatest(abs(a), abs(b)) * 0.05, 0)) THEN 'close' ELSE 'both_present' END
  WHEN a = 0 AND b > 0 THEN 'target_only' WHEN a > 0 AND b = 0 THEN 'source_only' ELSE 'mismatch' END AS r FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey),
g AS (SELECT n_regionkey, count(*) FILTER (r = 'exact') AS exact, count(*) FILTER (r = 'close') AS close, count(*) FILTER (r = 'both_present') AS both_present, count(*) FILTER (r <> 'missing_signal') AS compared FROM p GROUP BY n_regionkey),
h AS (SELECT *, coalesce(round_even((exact + close * 0.7::DOUBLE + both_present * 0.4::DOUBLE) / nullif(compared, 0), 4), 0) AS confidence FROM g)
SELECT *, CASE WHEN confidence >= 0.95 THEN 'high_confidence' WHEN confidence >= 0.75 THEN 'medium_confidence' WHEN confidence >= 0.45 THEN 'weak_signal' ELSE 'exploratory' END AS band FROM h""")
def relation_confidence(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("a"))
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg((F.count("*") * 15).alias("b"))
    return rules.confidence(n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left"), "n_regionkey", "a", "b")


@query("""WITH y AS (SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)
SELECT a.o_orderstatus, a.y AS y, round_even(greatest(0.0::DOUBLE, 1 - abs(a.n - b.n) / greatest(1.0::DOUBLE, a.n, b.n)), 4) AS similarity FROM y a JOIN y b ON a.o_orderstatus = b.o_orderstatus AND b.y = a.y + 1""")
def metric_similarity(spark, sf_dir):
    y = read(spark, sf_dir, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    b = y.select("o_orderstatus", (F.col("y") - 1).alias("y"), F.col("n").alias("m"))
    return y.join(b, ["o_orderstatus", "y"]).select("o_orderstatus", "y", T.metric_similarity(F.col("n"), F.col("m")).alias("similarity"))


@query("""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256(doc_id::VARCHAR), doc_id) <= round_even(0.7 * (SELECT count(*) FROM documents), 0) THEN 'discovery' ELSE 'validation' END AS split FROM documents""")
def hash_split(spark, sf_dir):
    return registers.hash_split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query()
def pilot_cover(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", (F.col("user_id") % 2).alias("family"), F.concat_ws(":", "event_type", F.hour("ts").cast("string")).alias("feature"))
    picks = registers.greedy_cover(e, "user_id", "feature", family="family")
    return spark.createDataFrame([(i, int(p)) for i, p in enumerate(picks)], "pick int, user_id long")


_CUES = [("press_release", 0, "positive", "the"), ("press_release", 0, "negative", "der"), ("product_manual", 1, "direct", "que"), ("product_manual", 1, "positive", "ción"), ("guide_document", 2, "direct", "und"), ("guide_document", 2, "positive", "ung")]
_CUE_ROWS = ", ".join(f"('{t}', {p}, {route.WEIGHTS[k]}, '{c}')" for t, p, k, c in _CUES)


@query(f"""WITH cue(target, p, w, c) AS (VALUES {_CUE_ROWS}),
s AS (SELECT conv_id, turn, target, p, sum(w)::DOUBLE AS score FROM conversations JOIN cue ON contains(lower(coalesce(text, '')), c) GROUP BY ALL HAVING sum(w) > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, p) AS r, max(score) OVER (PARTITION BY conv_id, turn) AS top FROM s),
n AS (SELECT conv_id, turn, max(top) AS top, count(*) FILTER (score >= top - 1.5) AS k, max(target) FILTER (r = 1) AS target FROM b GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN top IS NULL THEN 'not_found' WHEN top < 2.5 OR k > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome, CASE WHEN top >= 2.5 THEN target END AS target, CASE WHEN top >= 2.5 THEN top END AS score
FROM conversations LEFT JOIN n USING (conv_id, turn)""")
def route_query(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("_k", F.struct("conv_id", "turn"))
    cues = spark.createDataFrame(_CUES, "target string, position int, kind string, cue string")
    return route.route(c, cues, "_k").select("_k.conv_id", "_k.turn", "outcome", "target", "score")


@query("""WITH f AS (SELECT source, count(*) AS records, sum((l.quality = 1)::INTEGER)::BIGINT AS citable, sum((l.toxic = 0)::INTEGER)::BIGINT AS external FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source)
SELECT source, records, citable, external, concat_ws(',', CASE WHEN records < 40 THEN 'records' END, CASE WHEN coalesce(citable, 0) < 14 THEN 'citable' END, CASE WHEN coalesce(external, 0) < 17 THEN 'external' END) AS blockers,
CASE WHEN records >= 40 AND coalesce(citable, 0) >= 14 AND coalesce(external, 0) >= 17 THEN 'ready' WHEN records < 40 AND coalesce(citable, 0) < 14 AND coalesce(external, 0) < 17 THEN 'empty' ELSE 'blocked' END AS gate FROM f""")
def gate(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    facts = d.select("source", F.lit(1).alias("records"), (F.col("quality") == 1).cast("int").alias("citable"), (F.col("toxic") == 0).cast("int").alias("external"))
    return rules.gate(facts, "source", {"records": 40, "citable": 14, "external": 17})


@query("""WITH s AS (SELECT conv_id, turn, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM conversations)
SELECT conv_id, count(*) AS n, min(turn) AS first, coalesce(max(d), 0) AS largest_step, coalesce(bool_and(d = 1), true) AS gapless FROM s GROUP BY conv_id""")
def sequence_check(spark, sf_dir):
    return rules.sequence_gaps(read(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, role, max((role <> 'assistant')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM conversations) WHERE role = 'assistant' AND o = 1""")
def out_of_turn(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("done", F.col("role") == "assistant")
    return rules.out_of_turn(c, "conv_id", "turn", "done").select("conv_id", "turn")


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT user_id, ts, value, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n_events FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return sessions.sessions(read(spark, sf_dir, "events")).drop("total")
