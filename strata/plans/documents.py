"""Queries on the inner structure of documents: record streams, tables, controls, element trees, shapes, numbering."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from strata.operators import grids, sinks, trees
from strata.plans.registry import query, read
from strata.sources import containers, elements, paratext
from strata.sources.packed import packed

# Tables in record streams: an order is a document with one table, a line is a cell, some cells hold tables again


def _records(spark, sf_dir):
    """Record streams made of orders and their lines, shuffled; the places below leave room for what a line adds."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("n")).agg(F.max("l_quantity").cast("long").alias("q"))
    rec = lambda at, tag, level, body=F.lit(b""), when=F.lit(True): F.when(when, F.struct(at.cast("long").alias("idx"), F.lit(tag).alias("tag"), F.lit(level).alias("level"), body.alias("body")))
    table = lambda rows, columns, counts, zones=0: packed((F.lit(6), 4), (rows, 2), (columns, 2), (0, 10), *[(c, 2) for c in counts], (1, 2), (zones, 2), *[(0, 10)] * zones)
    cell = lambda column, row, column_span, row_span, more=13: packed((0, 6), (F.when(row == 0, 4).otherwise(0), 2), (column, 2), (row, 2), (column_span, 2), (row_span, 2), (0, 18), (0, more))
    doc = lines.groupBy("doc").agg(F.count("*").alias("k"), F.max("q").alias("q"))
    body = F.when(F.col("doc") % 5 == 0, packed((1, 4), (0, 2))).when(F.col("doc") % 5 == 1, table(F.lit(3), F.lit(4), [F.col("k"), 0, 0], 1)).otherwise(table(F.lit(3), F.lit(4), [F.col("k"), 0, 0]))
    body = F.when(F.col("doc") % 7 == 0, F.concat(body, F.lit(b"\x00"))).otherwise(body)
    p = F.lit
    head = [rec(p(0), "PARA_HEADER", 0), rec(p(1), "CTRL_HEADER", 1), rec(p(2), "LIST_HEADER", 2, when=F.col("doc") % 3 == 0), rec(p(3), "PARA_HEADER", 2, when=F.col("doc") % 3 == 0), rec(p(4), "TABLE", 2, body)]
    q, n, one = F.col("q"), F.col("n"), p(1)
    # what a line adds: at which place, on which level, and whether to lines of all quantities or to those that 2, 4 or 8 divide
    parts = [
        (0, "LIST_HEADER", 2, 1, b""), (1, "PARA_HEADER", 2, 1, b""), (2, "PARA_HEADER", 2, 2, b""), (3, "CTRL_HEADER", 3, 4, b""), (4, "TABLE", 4, 4, table(one, one, [1])),
        (5, "LIST_HEADER", 4, 4, cell(p(0), p(0), one, one)), (6, "PARA_HEADER", 4, 4, b""), (7, "CTRL_HEADER", 7, 8, b""), (8, "TABLE", 8, 8, table(one, one, [2])), (9, "LIST_HEADER", 8, 8, cell(p(0), p(0), one, one, 0)),
    ]
    own = F.array(*[F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in zip(("at", "tag", "level", "of", "body"), part, strict=True)]) for part in parts])
    own = lines.select("doc", "n", "q", F.explode(F.filter(own, lambda x: q % x["of"] == 0)).alias("r"))
    body = F.when(F.col("r.at") == 0, cell(q % 5, n % 4, q % 3, 1 + n % 2)).otherwise(F.col("r.body"))
    own = own.select("doc", (n * 20 + F.col("r.at")).alias("idx"), "r.tag", "r.level", body.alias("body"))
    return doc.select("doc", F.explode(F.array_compact(F.array(*head))).alias("r")).select("doc", "r.*").union(own)


_CELLS = """l AS (SELECT l_orderkey AS doc, max(l_quantity)::BIGINT AS q, l_linenumber::BIGINT AS n FROM lineitem GROUP BY l_orderkey, l_linenumber),
d AS (SELECT doc, count(*) AS k, CASE WHEN doc % 5 = 0 THEN 1 ELSE 3 END AS rows, CASE WHEN doc % 5 = 0 THEN 1 ELSE 4 END AS columns FROM l GROUP BY doc),
p AS (SELECT l.*, rows, columns, max(CASE WHEN q % 5 < columns AND n % 4 < rows AND q % 3 > 0 THEN n * 20 END) OVER (PARTITION BY doc ORDER BY n) AS cell FROM l JOIN d USING (doc)),
u AS (SELECT *, sum(CASE WHEN q % 2 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY doc, cell)::BIGINT AS paragraphs FROM p),
c AS (SELECT doc, 4 AS table_at, cell AS cell_at, n % 4 AS row, q % 5 AS col, 1 + n % 2 AS row_span, q % 3 AS column_span, true AS whole, paragraphs, rows, columns FROM u WHERE cell = n * 20
UNION ALL SELECT doc, n * 20 + 4, n * 20 + 5, 0, 0, 1, 1, true, 1, 1, 1 FROM l WHERE q % 4 = 0 UNION ALL SELECT doc, n * 20 + 8, n * 20 + 9, 0, 0, 1, 1, false, 0, 1, 1 FROM l WHERE q % 8 = 0),
s AS (SELECT doc, table_at, cell_at, row + i AS y, col + j AS x, col FROM c, range(2) a(i), range(2) b(j) WHERE i < row_span AND j < column_span AND row + i < rows AND col + j < columns),
o AS (SELECT DISTINCT a.doc, a.table_at, a.cell_at FROM s a JOIN s b ON a.doc = b.doc AND a.table_at = b.table_at AND a.y = b.y AND a.x = b.x AND (b.col < a.col OR (b.col = a.col AND b.cell_at < a.cell_at)))"""


@query(f"""WITH {_CELLS} SELECT doc, table_at, cell_at, (row_number() OVER (PARTITION BY doc, table_at ORDER BY cell_at) - 1)::INTEGER AS cell_no, row, col, row_span, column_span, row = 0 AS header, whole, paragraphs, o.cell_at IS NOT NULL AS overlaps
FROM c LEFT JOIN o USING (doc, table_at, cell_at)""")
def table_cells(spark, sf_dir):
    p = sinks.kept(grids.placed(_records(spark, sf_dir), "doc"), "placed")
    c = grids.cells(p, "doc")
    t = grids.table_fields(p.filter("tag = 'TABLE'"))
    return c.join(grids.swept(c, t, "doc").drop("slots"), ["doc", "table_at", "cell_at"]).withColumnRenamed("column", "col")


@query(f"""WITH {_CELLS},
t AS (SELECT doc, 4 AS table_at, rows, columns, CASE WHEN doc % 5 = 0 THEN 1 ELSE k END AS declared, CASE WHEN doc % 5 = 0 THEN 'NONE' ELSE 'CELL' END AS page_break, doc % 5 <> 0 AS repeat_header, (doc % 5 = 1)::INT AS zones,
CASE WHEN doc % 5 = 0 THEN 'short_body' WHEN doc % 7 = 0 THEN 'size_mismatch' ELSE 'parsed' END AS status, NULL AS owner_at, NULL AS owner_cell_at, CASE WHEN doc % 3 = 0 THEN 1 ELSE 0 END AS caption_paragraphs FROM d
UNION ALL SELECT doc, n * 20 + 4, 1, 1, 1, 'CELL', true, 0, 'parsed', CASE WHEN cell IS NOT NULL THEN 4 END, cell, 0 FROM p WHERE q % 4 = 0
UNION ALL SELECT doc, n * 20 + 8, 1, 1, 2, 'CELL', true, 0, 'parsed', n * 20 + 4, n * 20 + 5, 0 FROM l WHERE q % 8 = 0),
g AS (SELECT doc, table_at, count(DISTINCT cell_at) AS n_cells, count(DISTINCT (y, x)) AS covered FROM s GROUP BY ALL), v AS (SELECT doc, table_at, count(*) AS overlapping FROM o GROUP BY ALL)
SELECT doc, table_at, (row_number() OVER (PARTITION BY doc ORDER BY table_at) - 1)::INTEGER AS table_no, rows::BIGINT AS rows, columns::BIGINT AS columns, declared, page_break, repeat_header, zones::BIGINT AS zones, CASE WHEN status = 'parsed' AND coalesce(n_cells, 0) <> declared THEN 'cell_count_mismatch' ELSE status END AS status,
owner_at, owner_cell_at, coalesce(n_cells, 0) AS n_cells, coalesce(covered, 0) AS covered, coalesce(overlapping, 0) AS overlapping, caption_paragraphs::BIGINT AS caption_paragraphs FROM t LEFT JOIN g USING (doc, table_at) LEFT JOIN v USING (doc, table_at)""")
def record_tables(spark, sf_dir):
    return grids.tables(sinks.kept(grids.placed(_records(spark, sf_dir), "doc"), "placed"), "doc")


# Closures of any graph


_LINKS = "SELECT s_suppkey AS node, s_suppkey * 2 % 31 AS up FROM {t} UNION ALL SELECT s_suppkey, s_suppkey // 2 FROM {t} WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, NULL FROM {t} WHERE s_suppkey % 5 = 0"


@query(f"""WITH RECURSIVE e AS ({_LINKS.format(t="supplier")}), t AS (SELECT node, up AS ancestor, 1 AS depth FROM e WHERE up IS NOT NULL UNION SELECT t.node, e.up, t.depth + 1 FROM t JOIN e ON e.node = t.ancestor WHERE e.up IS NOT NULL AND t.depth < 60)
SELECT node, ancestor, min(depth) AS depth FROM t GROUP BY ALL""")
def graph_closure(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier")
    links = spark.sql(_LINKS.format(t="{supplier}").replace("//", "div"), supplier=supplier)
    return trees.closure(links, "node", "up")


# Controls in texts of 16-bit units: some letters of the documents stand for controls, so that what follows is their payload

_FROM, _TO = "qzjQXwYK", (11, 4, 30, 13, 2, 31, 9, 24)
_UNITS = f"""x AS (SELECT doc_id, flatten(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)]
{" ".join(f"WHEN c = '{c}' THEN [{k}]" for c, k in zip(_FROM, _TO, strict=True))} ELSE [unicode(c)] END)) AS u FROM documents),
e AS (SELECT doc_id, unnest(CASE WHEN doc_id % 7 = 0 THEN u[1:len(u) - 1] ELSE u END) AS c, generate_subscripts(CASE WHEN doc_id % 7 = 0 THEN u[1:len(u) - 1] ELSE u END, 1) - 1 AS i FROM x),
k AS (SELECT doc_id, list([i] ORDER BY i) AS k FROM e WHERE c IN (1, 2, 3, 11, 12, 14, 15, 16, 17, 18, 21, 22, 23, 4, 5, 6, 7, 8, 9, 19, 20) GROUP BY doc_id),
s AS (SELECT doc_id, unnest(list_reduce(k, lambda a, b: CASE WHEN b[1] >= a[len(a)] + 8 THEN list_concat(a, b) ELSE a END)) AS i FROM k),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
f AS (SELECT e.doc_id, e.i, e.c, n.n, s.i IS NOT NULL AS head, max(s.i) OVER w AS last_head, lag(e.c) OVER w AS prior FROM e JOIN n USING (doc_id) LEFT JOIN s ON s.doc_id = e.doc_id AND s.i = e.i WINDOW w AS (PARTITION BY e.doc_id ORDER BY e.i)),
g AS (SELECT *, head AND i + 8 > n AS short, last_head IS NULL OR i >= last_head + 8 AS free FROM f),
h AS (SELECT *, free AND c < 32 AS single, free AND c >= 32 AS plain, free AND c BETWEEN 56320 AND 57343 AND prior BETWEEN 55296 AND 56319 AND (last_head IS NULL OR i > last_head + 8) AS second FROM g),
v AS (SELECT *, coalesce(sum(CASE WHEN plain AND NOT second OR single AND c IN (10, 30, 31) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM h)"""


def _tokenized(spark, sf_dir):
    text = F.translate(F.coalesce("text", F.lit("")), _FROM, "".join(map(chr, _TO)))
    body = F.encode(text, "UTF-16LE")
    # one byte less: the last unit is incomplete
    body = F.when(F.col("doc_id") % 7 == 0, F.substring(body, F.lit(1), F.octet_length(body) - 1)).otherwise(body)
    return paratext.tokenized(read(spark, sf_dir, "documents").select("doc_id", body.alias("body")), "body")


@query(f"""WITH {_UNITS}, t AS (SELECT doc_id, i, c, before, n, CASE WHEN head AND short THEN 'malformed' WHEN head AND c IN (4, 5, 6, 7, 8, 9, 19, 20) THEN 'inline' WHEN head THEN 'extended' WHEN single THEN 'character'
WHEN plain AND NOT coalesce(lag(plain) OVER (PARTITION BY doc_id ORDER BY i), false) THEN 'text' END AS kind FROM v),
p AS (SELECT doc_id, i, kind, c, before, n, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next, lead(before) OVER (PARTITION BY doc_id ORDER BY i) AS next_before FROM t WHERE kind IS NOT NULL),
w AS (SELECT doc_id, max(before + (CASE WHEN plain AND NOT second OR single AND c IN (10, 30, 31) THEN 1 ELSE 0 END)) AS width FROM v GROUP BY doc_id)
SELECT p.doc_id, (row_number() OVER (PARTITION BY p.doc_id ORDER BY i) - 1)::INTEGER AS token_no, kind, CASE WHEN kind <> 'text' THEN c END AS code, i::INTEGER AS start, coalesce(next, n)::INTEGER AS stop, before::INTEGER AS visible_start, coalesce(next_before, width)::INTEGER AS visible_end FROM p JOIN w USING (doc_id)""")
def control_tokens(spark, sf_dir):
    t = _tokenized(spark, sf_dir).select("doc_id", F.posexplode("tokens").alias("token_no", "t"))
    return t.select("doc_id", "token_no", "t.kind", "t.code", "t.start", F.col("t.end").alias("stop"), "t.visible_start", "t.visible_end")


@query(f"""WITH {_UNITS}, p AS (SELECT doc_id, i, c, before - second::INT AS place, plain AND NOT second OR single AND c IN (10, 30, 31) AS shown, lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS next, head, short, plain, second FROM v),
q AS (SELECT doc_id, count(*) AS units, count(*) FILTER (shown) AS width, count(*) FILTER (head AND NOT short) * 7 AS payload_units, count(*) FILTER (head AND short) AS malformed, sum((i + 1) * place)::BIGINT AS map_sum,
coalesce(string_agg(chr(CASE WHEN c IN (30, 31) THEN 32 WHEN c BETWEEN 55296 AND 56319 THEN 65536 + ((c - 55296) << 10) + next - 56320 ELSE c END::INTEGER), '' ORDER BY i) FILTER (shown AND NOT (c BETWEEN 55296 AND 56319 AND NOT coalesce(next BETWEEN 56320 AND 57343, false)) AND NOT c BETWEEN 56320 AND 57343), '') AS visible FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(units, 0)::INTEGER AS units, coalesce(width, 0)::INTEGER AS width, coalesce(payload_units, 0) AS payload_units, coalesce(malformed, 0) AS malformed, (coalesce(map_sum, 0) + (coalesce(units, 0) + 1) * coalesce(width, 0))::BIGINT AS map_sum, md5(coalesce(visible, '')) AS visible_md5 FROM documents d LEFT JOIN q USING (doc_id)""")
def control_maps(spark, sf_dir):
    m = F.col("to_visible").cast("array<bigint>")
    total = F.aggregate(F.transform(m, lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return _tokenized(spark, sf_dir).select("doc_id", (F.size("to_visible") - 1).alias("units"), F.element_at("to_visible", -1).alias("width"), "payload_units", "malformed", total.alias("map_sum"), F.md5("visible").alias("visible_md5"))


# Sections of XML as blocks and losses: a conversation is a section, a turn a child of its root, in eight forms

_XML_TEXT = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_FORMS = [
    f"'<p a=\"1\"><run><t>' || {_XML_TEXT} || '</t></run></p>'",
    f"'<p><run><t>' || {_XML_TEXT} || '</t></run><run><hp:tbl rows=\"1\"><tr><tc><p><run><t>in</t></run><run><pic/></run></p></tc></tr></hp:tbl></run></p>'",
    "'<p><run><rect><pic/><x><pic></pic></x></rect></run></p>'",
    "'<p><!-- <ole/> --><run><rect><tbl><tr/></tbl><pic/></rect></run><run><ole/></run></p>'",
    "'<p><run><container><ellipse/></container><equation/><t>end</t></run></p>'",
    "'<tbl><tr><tc><p><run><t>cell</t></run></p></tc></tr></tbl>'",
    "'<memo><p><run><t>lost</t></run></p></memo>'",
    "'<p><run><t>a<tab/>b</t></run><p><run><t>nested</t></run><pic/></p><run><t>c</t></run>off</p>'",
]
#: What the forms above must give: kinds in order, text, losses.
_FORM_BLOCKS = [["paragraph"], ["paragraph", "table"], ["paragraph", "picture", "picture"], ["paragraph", "drawing"], ["paragraph", "drawing"], ["table"], [], ["paragraph"]]
_FORM_TEXTS = ["coalesce(text, '')", "coalesce(text, '')", "''", "''", "'end'", "NULL", "NULL", "'abc'"]
_FORM_LOSSES = {3: "unsupported_object:ole", 4: "unsupported_object:equation", 6: "unsupported_section_child:memo"}
_FORM = "CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_FORMS)) + " END"
_TURNS = "SELECT conv_id, turn, min(text) AS text FROM {t} GROUP BY conv_id, turn"


def _sections(spark, sf_dir):
    turns = spark.sql(_TURNS.format(t="{c}"), c=read(spark, sf_dir, "conversations"))
    piece = turns.select("conv_id", "turn", F.expr(_FORM).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda s: s["x"]), "")
    tail = F.when(F.col("conv_id") % 9 == 0, "<p></run>").when(F.col("conv_id") % 11 == 0, "<p>").otherwise("")
    return piece.groupBy("conv_id").agg(body.alias("x")).select("conv_id", F.concat(F.lit("<?xml version='1.0'?><sec>"), "x", tail, F.lit("</sec>")).alias("xml"))


def _blocks(spark, sf_dir):
    t = sinks.kept(elements.tokens(_sections(spark, sf_dir), "conv_id", "xml"), "tokens")
    return elements.section_blocks(t, sinks.kept(elements.elements(t, "conv_id"), "elements"), "conv_id")


@query(f"""WITH t AS ({_TURNS.format(t="conversations")}), f AS (SELECT *, (conv_id + turn) % 8 AS form FROM t WHERE conv_id % 9 <> 0 AND conv_id % 11 <> 0),
b AS (SELECT *, CASE form {" ".join(f"WHEN {i} THEN {b}::VARCHAR[]" for i, b in enumerate(_FORM_BLOCKS))} END AS kinds, CASE form {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_FORM_TEXTS))} END AS body FROM f),
u AS (SELECT conv_id, turn, body, unnest(kinds) AS kind, generate_subscripts(kinds, 1) AS i FROM b)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, i))::INTEGER AS block_no, kind, i > 1 AS anchored, CASE WHEN kind = 'paragraph' THEN body END AS text FROM u""")
def section_blocks(spark, sf_dir):
    blocks, _ = _blocks(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("at"))
    return blocks.select("conv_id", place.alias("block_no"), "kind", F.col("anchor").isNotNull().alias("anchored"), "text")


@query(f"""WITH t AS ({_TURNS.format(t="conversations")}), l AS (SELECT conv_id, CASE (conv_id + turn) % 8 {" ".join(f"WHEN {i} THEN '{x}'" for i, x in _FORM_LOSSES.items())} END AS loss FROM t WHERE conv_id % 9 <> 0 AND conv_id % 11 <> 0
UNION ALL SELECT DISTINCT conv_id, 'xml_parse_failed' FROM t WHERE conv_id % 9 = 0 OR conv_id % 11 = 0)
SELECT conv_id, loss, count(*) AS n FROM l WHERE loss IS NOT NULL GROUP BY ALL""")
def section_losses(spark, sf_dir):
    return _blocks(spark, sf_dir)[1]


_REFS = r"CASE doc_id % 8 WHEN 0 THEN '&#1;' WHEN 1 THEN '&#x0;b' WHEN 2 THEN '&#55296;' WHEN 3 THEN '&#x110000;&#9;' WHEN 4 THEN '&#xfffe;&#xFFFD;' WHEN 5 THEN '&#99999999999999999999999;' WHEN 6 THEN '&#x41;&amp;&#10;' ELSE '' END"
_BAD = r"&#0*(?:[0-8]|1[124-9]|2[0-9]|3[01]|5529[6-9]|55[3-9][0-9][0-9]|56[0-9]{3}|57[0-2][0-9]{2}|573[0-3][0-9]|5734[0-3]|6553[45]|111411[2-9]|11141[2-9][0-9]|1114[2-9][0-9]{2}|111[5-9][0-9]{3}|11[2-9][0-9]{4}|1[2-9][0-9]{5}|[2-9][0-9]{6}|[1-9][0-9]{7,});|&#x0*(?:[0-8bcBCeEfF]|1[0-9a-fA-F]|[dD][89a-fA-F][0-9a-fA-F]{2}|[fF]{3}[eEfF]|1[1-9a-fA-F][0-9a-fA-F]{4}|[2-9a-fA-F][0-9a-fA-F]{5}|[1-9a-fA-F][0-9a-fA-F]{6,});"


@query(f"SELECT doc_id, md5(regexp_replace(x, '{_BAD}', '&#xFFFD;', 'g')) AS md5, len(regexp_extract_all(x, '{_BAD}')) AS n FROM (SELECT doc_id, {_REFS} || coalesce(text, '') || {_REFS} AS x FROM documents)")
def repaired_texts(spark, sf_dir):
    x = F.expr(f"{_REFS} || coalesce(text, '') || {_REFS}")
    r = read(spark, sf_dir, "documents").select("doc_id", elements.repaired(x).alias("r"))
    return r.select("doc_id", F.md5("r.text").alias("md5"), F.col("r.n").cast("long").alias("n"))


# Tagged records in deflated streams: a record for each line of an order, one of them longer than its head can say


@query("""WITH l AS (SELECT l_orderkey AS path, l_linenumber::BIGINT AS n, max(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER w - 1 AS idx, lead(n) OVER w IS NULL AS final, CASE WHEN q > 48 THEN 4100 + q ELSE q * 2 END AS size FROM l WINDOW w AS (PARTITION BY path ORDER BY n))
SELECT path, idx::INTEGER AS idx, (66 + n)::INTEGER AS tag, (n % 4)::INTEGER AS level, size, CASE WHEN path % 6 = 0 AND final THEN size - 1 ELSE size END AS bytes, CASE WHEN path % 6 = 0 AND final THEN 'truncated_body' ELSE 'ok' END AS status FROM r
UNION ALL SELECT path, count(*)::INTEGER, NULL, NULL, NULL, NULL, 'truncated_header' FROM l WHERE path % 6 = 1 GROUP BY path""")
def tagged_records(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("n")).agg(F.max("l_quantity").cast("long").alias("q"))
    n, q = F.col("n"), F.col("q")
    size = F.when(q > 48, 4100 + q).otherwise(q * 2)
    head = packed((66 + n + (n % 4) * 1024 + F.when(q > 48, 0xFFF).otherwise(size) * (1 << 20), 4))
    record = F.concat(head, F.when(q > 48, packed((size, 4))).otherwise(F.lit(b"")), F.repeat(F.lit("z"), size.cast("int")).cast("binary"))
    s = lines.select("path", F.struct("n", record.alias("r")).alias("s")).groupBy("path").agg(F.array_sort(F.collect_list("s")).alias("s"))
    whole = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["r"]))
    d = sinks.kept(s.select("path", whole.alias("b")), "streams")
    cut = F.when(F.col("path") % 6 == 0, F.substring("b", F.lit(1), F.octet_length("b") - 1)).when(F.col("path") % 6 == 1, F.concat("b", F.lit(b"\0\0"))).otherwise(F.col("b"))
    # a stored block of raw deflate: its mark, the length, the length's complement, the bytes
    d = sinks.kept(d.select("path", cut.alias("b")), "streams").select(F.col("path").cast("string").alias("path"), F.lit("s").alias("stream"), F.concat(packed((1, 1), (F.octet_length("b"), 2), (65535 - F.octet_length("b"), 2)), "b").alias("bytes"))
    return containers.tagged_records(d).select(F.col("path").cast("long").alias("path"), "idx", "tag", "level", "size", F.octet_length("body").cast("long").alias("bytes"), "status")
