"""Queries on layout and bytes: nested shapes, figures, numbered headings, line segments, charsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import geometry as G
from strata.operators import html, numbering, sinks
from strata.plans.registry import query, read
from strata.sources import charsets
from strata.sources import packed as P
from strata.sources import shapes as S

# Nested shapes: a part hangs below the part whose key is a tenth of its own; each is scaled, turned by quarters and moved

_SHAPES = "SELECT p_partkey AS k, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS up, p_size AS s, ([1, 0, -1, 0])[p_partkey % 4 + 1] AS co, ([0, 1, 0, -1])[p_partkey % 4 + 1] AS si, (0.5 + p_partkey % 3 * 0.5)::DOUBLE AS z FROM part"


@query(f"""WITH RECURSIVE s AS ({_SHAPES}), o AS (SELECT k, up, s, co * z AS a, -si * z AS b, (s + k % 7)::DOUBLE AS c, si * z AS d, co * z AS e, (k % 11 - s / 2)::DOUBLE AS f, z FROM s),
w AS (SELECT k, k AS root, 0 AS depth, s, a, b, c, d, e, f, z::DOUBLE AS z FROM o WHERE up IS NULL OR up NOT IN (SELECT k FROM o)
UNION ALL SELECT o.k, w.root, w.depth + 1, o.s, w.a * o.a + w.b * o.d, w.a * o.b + w.b * o.e, w.a * o.c + w.b * o.f + w.c, w.d * o.a + w.e * o.d, w.d * o.b + w.e * o.e, w.d * o.c + w.e * o.f + w.f, w.z * o.z FROM o JOIN w ON o.up = w.k),
r AS (SELECT *, greatest(1, round_even(greatest(1, s) * z, 0))::BIGINT AS rw, greatest(1, round_even(greatest(1, s * 2) * z, 0))::BIGINT AS rh, round_even(c, 0)::BIGINT AS x, round_even(f, 0)::BIGINT AS y FROM w),
l AS (SELECT *, greatest(0, least(x, greatest(0, 120 - rw))) AS l, greatest(0, CASE WHEN y < 0 OR y + rh > 90 THEN CASE WHEN depth = 0 THEN trunc(90 * 0.015)::BIGINT ELSE trunc(90 * (0.085::DOUBLE + 0.02::DOUBLE * (depth - 1)))::BIGINT END ELSE y END) AS t FROM r)
SELECT k AS p_partkey, root, depth, c AS x, f AS y, l AS left, t AS top, least(rw, greatest(1, 120 - l)) AS width, least(rh, greatest(1, 90 - t)) AS height FROM l""")
def nested_shapes(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    quarter = lambda *v: F.get(F.array(*map(F.lit, v)), (k % 4).cast("int"))
    co, si, z = quarter(1, 0, -1, 0), quarter(0, 1, 0, -1), 0.5 + k % 3 * 0.5
    m = lambda kind, *v: F.struct(F.lit(kind).alias("kind"), G.affine(list(v)).alias("m"))
    steps = F.array(m(G.SCALE, z, 0, 0, 0, z, 0), m("rotMatrix", co, -si, 0, si, co, 0), m("transMatrix", 1, 0, s + k % 7, 0, 1, k % 11 - s / 2))
    shapes = read(spark, sf_dir, "part").select("p_partkey", s.alias("p_size"), F.expr("case when p_partkey >= 10 then p_partkey div 10 end").alias("up"), G.composed(steps).alias("c"))
    p = G.placed(shapes.select("p_partkey", "up", "c.*"), "p_partkey", "up").join(shapes.select("p_partkey", "p_size"), "p_partkey")
    b = G.box(s, s * 2, F.col("map"), F.col("scale_x"), F.col("scale_y"), F.lit(120), F.lit(90), F.col("depth"))
    return p.select("p_partkey", "root", "depth", F.col("map.c").alias("x"), F.col("map.f").alias("y"), b.alias("b")).select("p_partkey", "root", "depth", "x", "y", "b.*")


# Figures of reports: pages with figures nested, unclosed, commented out, on the cover

_PARTS = (
    '<figure class="x"><p>no media</p></figure>', "<figure><figure><img src=a></figure><svg></svg></figure>", "<FIGURE><canvas></canvas>", '<figure id=1 class="flow-x">text</figure><div id="a" class="my-chart b">', "<section class='cover-page'><img><table></table></section>",
    '<!-- <img> <table> --><style>\n<svg></style><table border=1>자료: 근거 데이터', '<article class="timeline"><sup>1</sup> Appendix footnote</article>', 'data-assembled-report="true" Chapter 0 : Executive  Summary<svgx><imgs>',
)
_PAGE = "coalesce(html, '') || CASE page_id % 8 " + " ".join("WHEN {} THEN '{}'".format(i, x.replace("'", "''")) for i, x in enumerate(_PARTS)) + " END || CASE page_id % 3 WHEN 0 THEN '<figure><img></figure>' WHEN 1 THEN 'tail </figure>' ELSE '' END"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(rf"""WITH p AS (SELECT page_id, {_PAGE} AS raw FROM pages), a AS (SELECT page_id, raw, regexp_replace(raw, '(?s)<!--.*?-->', '', 'g') AS shown FROM p),
m AS (SELECT *, regexp_replace(regexp_replace(shown, '(?is)<style\b[^>]*>.*?</style>', '', 'g'), {_q(html._COVER)}, '', 'g') AS material,
trim(regexp_replace(regexp_replace(regexp_replace(shown, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS visible FROM a),
f AS (SELECT *, regexp_extract_all(material, '{html._FIGURE}') AS figs, regexp_replace(material, '{html._FIGURE}', '', 'g') AS rest FROM m)
SELECT page_id, length(visible) AS visible_chars, len(regexp_extract_all(material, '(?i)<table\b')) AS tables, len(list_filter(figs, lambda b: regexp_matches(b, '{html.MEDIA}') OR regexp_matches(b, {_q(html.VISUAL_CLASS)}))) + len(regexp_extract_all(rest, '{html.MEDIA}')) + len(regexp_extract_all(rest, {_q(html._CONTAINER)})) AS figures,
len(string_split(visible, '자료:')) - 1 AS source_captions, len(string_split(visible, '근거 데이터')) - 1 AS data_captions, regexp_matches(visible, '(?i)\bappendix\b') OR contains(visible, '부록') AS appendix, len(regexp_extract_all(raw, '(?i)<sup\b|footnote|주석|참고문헌')) AS footnotes,
contains(raw, 'timeline') AS uses_template, contains(raw, 'data-assembled-report="true"') AS assembled, contains(raw, 'cover-page') AS uses_cover, regexp_matches(visible, '{html._SUMMARY}') AS summary FROM f""")
def report_metrics(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.report_metrics(F.expr(_PAGE), template=("timeline",), cover=("cover-page",)).alias("m")).select("page_id", "m.*")


# Numbered headings: the events of a user are headings on five levels

_LEVEL = "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 9 ELSE 1 + event_id * event_id % 7 % 5 END"


@query(f"""WITH e AS (SELECT user_id, event_id, {_LEVEL} AS lv FROM events), l AS (SELECT * FROM e, range(1, 6) r(i) WHERE lv <= 5 AND i <= lv),
b AS (SELECT l.user_id, l.event_id, l.lv, l.i, coalesce(max(t.event_id), -1) AS base FROM l LEFT JOIN e t ON t.user_id = l.user_id AND t.lv < l.i AND t.event_id <= l.event_id GROUP BY ALL),
c AS (SELECT b.user_id, b.event_id, b.lv, b.i, count(s.event_id) + CASE WHEN b.i = 2 THEN 4 ELSE 0 END AS n FROM b LEFT JOIN e s ON s.user_id = b.user_id AND s.lv = b.i AND s.event_id <= b.event_id AND s.event_id > b.base GROUP BY b.user_id, b.event_id, b.lv, b.i),
g AS (SELECT event_id, lv, list(n ORDER BY i) AS n FROM c GROUP BY ALL)
SELECT e.event_id, e.lv AS level, CASE WHEN e.lv = 1 THEN n[1] || '.' WHEN e.lv = 2 THEN '(' || n[1] || '-' || CASE WHEN n[2] BETWEEN 1 AND 26 THEN chr(64 + n[2]::INTEGER) ELSE n[2]::VARCHAR END || ')^3'
ELSE array_to_string(list_transform(n, lambda x, i: CASE WHEN i = 2 AND x BETWEEN 1 AND 26 THEN chr(64 + x::INTEGER) WHEN i = 4 AND x BETWEEN 1 AND 9 THEN (['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[x] ELSE x::VARCHAR END), '.') END AS label
FROM e LEFT JOIN g ON g.event_id = e.event_id""")
def heading_labels(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_LEVEL).alias("level"))
    c = numbering.counters(e, "user_id", "event_id", "level", levels=5, starts=(1, 5))
    return numbering.labels(c, "level", {1: "^1.", 2: "(^1-^2)^3"}, {2: "LATIN_CAPITAL", 4: "ROMAN_CAPITAL"}).select("event_id", "level", "label")


# Line segments: the lines of an order packed side by side, some cut short, some declared wrongly


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, max(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL), o AS (SELECT k, count(*) AS c FROM l GROUP BY k)
SELECT k AS l_orderkey, (c - CASE WHEN k % 5 = 1 THEN 1 ELSE 0 END)::INTEGER AS segments, (CASE WHEN k % 5 = 1 THEN 35 ELSE 0 END)::BIGINT AS rest, CASE WHEN k % 5 = 1 THEN 'trailing_bytes' WHEN k % 3 = 0 THEN 'declared_count_mismatch' ELSE 'parsed' END AS status,
coalesce(s, 0) AS textpos, coalesce(v, 0) AS vertpos, coalesce(b, 0) AS first_on_page FROM o LEFT JOIN (SELECT l.k, sum(n * 100000)::BIGINT AS s, sum(-q * n)::BIGINT AS v, count(*) FILTER (q % 2 = 1) AS b FROM l JOIN o ON o.k = l.k WHERE n < (SELECT max(n) FROM l x WHERE x.k = l.k) OR l.k % 5 <> 1 GROUP BY l.k) USING (k)""")
def line_segments(spark, sf_dir):
    n, q = F.col("n"), F.col("q")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n")).agg(F.max("l_quantity").cast("long").alias("q"))
    body = P.packed((n * 100000, 4), (-q * n, 4), (q, 4), (q, 4), (q, 4), (0, 4), (-1, 4), (n, 4), (q % 2 + 2147483648, 4))
    one = lines.select("k", F.struct("n", body.alias("b")).alias("s")).groupBy("k").agg(F.array_sort(F.collect_list("s")).alias("s"))
    whole = F.aggregate("s", F.lit(b""), lambda a, s: F.concat(a, s["b"]))
    cut = F.when(F.col("k") % 5 == 1, F.substring(whole, F.lit(1), F.octet_length(whole) - 1)).otherwise(whole)
    d = P.line_segments(one.select("k", (F.size("s") + F.when(F.col("k") % 3 == 0, 2).otherwise(0)).alias("declared"), cut.alias("body")), "body", "declared")
    total = lambda f: F.aggregate(F.transform("segments", f), F.lit(0).cast("long"), lambda a, b: a + b)
    return d.select(F.col("k").alias("l_orderkey"), F.size("segments").alias("segments"), F.col("segments_rest").alias("rest"), "status", total(lambda s: s["textpos"]).alias("textpos"), total(lambda s: s["vertpos"]).alias("vertpos"), total(lambda s: P.bit(s["flags"], 0).cast("long")).alias("first_on_page"))


# Charsets: pages as bytes of five kinds

_ASCII = "regexp_replace(coalesce(html, ''), '[^ -~\\n]', '', 'g')"


@query(f"""SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'cp949' WHEN 2 THEN 'latin-1' WHEN 3 THEN 'UTF-16LE' WHEN 5 THEN 'iso-8859-1' ELSE 'utf-8' END AS charset, md5(CASE page_id % 6 WHEN 1 THEN 'e' || replace({_ASCII}, 'e', '가') || '각' WHEN 2 THEN 'é' || {_ASCII} || 'ÿ'
WHEN 5 THEN {_ASCII} || 'Ã©' ELSE coalesce(html, '') END) AS md5 FROM pages""")
def decoded_pages(spark, sf_dir):
    h, kind = F.coalesce("html", F.lit("")), F.col("page_id") % 6
    ascii_only = F.regexp_replace(h, r"[^ -~\n]", "")
    latin = lambda c: F.encode(c, "ISO-8859-1")
    # the two syllables as the bytes that cp949 has for them, written as the Latin characters of these bytes
    korean = F.concat(F.lit("e"), F.replace(ascii_only, F.lit("e"), F.lit("\xb0\xa1")), F.lit("\xb0\xa2"))
    body = F.when(kind == 1, latin(korean)).when(kind == 2, latin(F.concat(F.lit("é"), ascii_only, F.lit("ÿ")))).when(kind == 3, F.encode(h, "UTF-16LE")).when(kind == 5, F.concat(latin(ascii_only), F.lit(b"\xc3\xa9"))).otherwise(F.encode(h, "UTF-8"))
    header = F.when(kind == 3, 'text/html; Charset="UTF-16LE"; x=1').when(kind == 4, "text/html; charset=no-such-charset").when(kind == 5, "charset=iso-8859-1").otherwise("text/html")
    d = charsets.decoded(read(spark, sf_dir, "pages").select("page_id", body.alias("body"), charsets.declared(header).alias("named")), "body", "named")
    return d.select("page_id", "charset", F.md5("text").alias("md5"))


# Style records: a part is a document with a shape of characters and one of paragraphs, and a border whose fill its key decides

_FLAGS = "(p_partkey % 2) + (p_partkey % 3 % 2) * 2 + (p_partkey % 4) * 4 + (p_partkey % 19 % 16) * 16 + (p_partkey % 8) * 256 + (p_partkey % 3) * 2048 + (p_partkey % 6 // 3) * 262144 + (p_partkey % 9) * 2097152 + (p_partkey % 5 % 2) * 33554432 + (p_partkey % 17) % 16 * 67108864"
_PARA_FLAGS = "(p_partkey % 8) * 4 + (p_partkey % 4) * 32 + (p_partkey % 2) * 128 + (p_partkey % 100) * 512 + (p_partkey % 3 % 2) * 524288 + (p_partkey % 4) * 1048576 + (p_partkey % 4) * 8388608 + (p_partkey % 7) * 33554432"


def _spread(spark, parts):
    """Parts dealt to all cores: a file of few bytes a row is read by one task, and records take much longer to decode than to read."""
    return parts.repartition(spark.sparkContext.defaultParallelism, "p_partkey")


def _name(names, code: str, other: str) -> str:
    return f"coalesce(([{', '.join(repr(n) for n in names)}])[{code} + 1], '{other}')"


def _hex(value: str) -> str:
    return f"'#' || upper(lpad(to_hex({value}), 6, '0'))"


@query(f"""SELECT p_partkey, 'char' AS kind, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat_ws('|', p_size * 100, (p_size + 6) % 65536, -(p_size % 10), p_partkey % 2 = 1, p_partkey % 3 % 2 = 1, {_name(S.UNDERLINES, "p_partkey % 4", "NONE")}, CASE WHEN p_partkey % 2 = 1 THEN {_name(S.LINE_SHAPES, "p_partkey % 19 % 16", "SOLID")} ELSE 'SOLID' END,
{_name(S.OUTLINES, "p_partkey % 8", "NONE")}, {_name(S.SHADOWS, "p_partkey % 3", "NONE")}, CASE WHEN p_partkey % 6 >= 3 THEN {_name(S.LINE_SHAPES, "p_partkey % 17 % 16", "SOLID")} ELSE 'NONE' END, {_name(S.MARKS, "p_partkey % 9", "NONE")}, p_partkey % 5 % 2 = 1, {_hex("p_partkey % 256 * 65536 + p_size * 256 + 7")}, CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE '#000000' END, p_size) END AS fields FROM part
UNION ALL SELECT p_partkey, 'para', CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat_ws('|', {_name(S.HORIZONTAL, "p_partkey % 8", "JUSTIFY")}, {_name(S.VERTICAL, "p_partkey % 4", "BASELINE")}, {_name(S.LATIN_BREAKS, "p_partkey % 4", "KEEP_WORD")}, CASE WHEN p_partkey % 2 = 1 THEN 'KEEP_WORD' ELSE 'BREAK_WORD' END, p_partkey % 100, p_partkey % 3 % 2 = 1, {_name(S.HEADINGS, "p_partkey % 4", "NONE")},
CASE WHEN p_partkey % 4 = 0 OR p_partkey % 13 = 0 THEN 0 ELSE p_partkey % 1000 END, p_partkey % 7, -p_size, p_size * 10, CASE WHEN p_partkey % 3 = 0 THEN p_size * 7 ELSE p_size * 5 END, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 0 END) END FROM part""")
def style_shapes(spark, sf_dir):
    p = _spread(spark, read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size")))
    k, s = F.col("p_partkey"), F.col("p_size")
    seven = lambda v, w: [(v(i), w) for i in range(7)]
    flags = lambda e: F.expr(e.replace("//", "div"))
    char = P.packed(*seven(lambda i: s + i, 2), *seven(lambda i: 100, 1), *seven(lambda i: -(s % 10), 1), *seven(lambda i: 100, 1), *seven(lambda i: 0, 1), (s * 100, 4), (flags(_FLAGS), 4), (-1, 1), (1, 1), (k % 256 + s * 256 + 7 * 65536, 4), (0, 4), (F.when(k % 3 == 0, -1).otherwise(0), 4), (0, 4), (s, 2))
    para = P.packed((flags(_PARA_FLAGS), 4), (-s, 4), (s * 10, 4), (0, 4), (0, 4), (0, 4), (s * 5, 4), (1, 2), (F.when(k % 13 == 0, 65535).otherwise(k % 1000), 2), (2, 2), (0, 8))
    more = P.packed((0, 4), (0, 4), (s * 7, 4), (0, 4))
    para = F.when(k % 3 == 0, F.concat(para, more)).otherwise(para)
    short = lambda b, m: F.when(k % m == 0, F.substring(b, F.lit(1), F.lit(40))).otherwise(b)
    bodies = sinks.kept(p.select("p_partkey", short(char, 10).alias("char"), short(para, 11).alias("para")), "shapes")
    d = bodies.select("p_partkey", S.char_shape(F.col("char")).alias("c"), S.para_shape(F.col("para")).alias("q"))
    texts = lambda c, names: F.when(F.col(c).isNotNull(), F.concat_ws("|", *[n.cast("string") for n in names]))
    c, q = F.col("c"), F.col("q")
    chars = texts("c", [c["height"], c["font_ref"][6], c["spacing"][0], c["italic"], c["bold"], c["underline"], c["underline_shape"], c["outline"], c["shadow"], c["strikeout"], c["sym_mark"], c["use_font_space"], c["text_color"], c["shade_color"], c["border_fill_id"]])
    paras = texts("q", [q["horizontal"], q["vertical"], q["break_latin"], q["break_other"], q["condense"], q["page_break_before"], q["heading"], q["heading_ref"], q["heading_level"], q["left"], q["right"], q["line_spacing"], q["extension_bytes"]])
    return d.select("p_partkey", F.lit("char").alias("kind"), chars.alias("fields")).union(d.select("p_partkey", F.lit("para"), paras))


@query(f"""SELECT p_partkey, {_name(S.LINES, "p_partkey % 20", "NONE")} || ' ' || ([{', '.join(repr(w) for w in S.WIDTHS)}])[p_size % 16 + 1] || ' mm ' || CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE {_hex("p_size * 65536 + 515")} END AS left, {_name(S.SLASHES, "p_partkey % 8", "NONE")} AS slash, p_partkey % 3 = 1 AS crooked,
CASE p_partkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'solid' WHEN 2 THEN 'gradation' WHEN 3 THEN 'image' WHEN 4 THEN 'none' WHEN 5 THEN 'gradation' ELSE 'unsupported' END AS type, CASE p_partkey % 7 WHEN 1 THEN '#010203,' || CASE WHEN p_size % 2 = 1 THEN 'none' ELSE '#04050607'[1:1] || '08' || '050607' END WHEN 2 THEN '#0A0B0C,#0D0E0F' ELSE '' END AS colors,
CASE p_partkey % 7 WHEN 1 THEN {_name(S.HATCHES[1:], "p_size % 6", "")} WHEN 2 THEN {_name(S.GRADATIONS, "p_size % 6", "LINEAR")} WHEN 3 THEN {_name(S.MODES, "p_size % 17", "FIT_SIZE")} || '/' || {_name(S.EFFECTS, "p_size % 5", "REAL_PIC")} END AS style, CASE p_partkey % 7 WHEN 2 THEN '-' || p_size || ',50,60,9,' || CASE WHEN p_size % 3 = 0 THEN '77' ELSE '50' END WHEN 3 THEN '-5,7,' || p_size ELSE '' END AS numbers,
CASE p_partkey % 7 WHEN 4 THEN 'truncated_fill_type' WHEN 5 THEN 'truncated_gradation_positions' WHEN 6 THEN 'unsupported_fill_type' ELSE 'parsed' END AS status FROM part""")
def border_fills(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    head = P.packed((k % 8 * 4 + F.when(k % 3 == 1, 256).otherwise(0), 2), (k % 20, 1), (s % 16, 1), (F.when(k % 4 == 0, -1).otherwise(s + 2 * 256 + 3 * 65536), 4), (0, 8), (0, 8), (0, 8))
    kind = k % 7
    solid = P.packed((1, 4), (0x030201, 4), (F.when(s % 2 == 1, -1).otherwise(0x08070605), 4), (s % 6 + 1, 4), (0, 4))
    grade = P.packed((4, 4), (s % 6, 1), (-s, 4), (50, 4), (60, 4), (9, 4), (2, 4), (0x0C0B0A, 4), (0x0F0E0D, 4), (F.when(s % 3 == 0, 1).otherwise(0), 4))
    grade = F.concat(grade, F.when(s % 3 == 0, F.lit(b"\x4d")).otherwise(F.lit(b"")))
    image = P.packed((2, 4), (s % 17, 1), (-5, 1), (7, 1), (s % 5, 1), (s, 2), (0, 4))
    fill = F.when(kind == 0, P.packed((0, 4), (0, 4))).when(kind == 1, solid).when(kind == 2, grade).when(kind == 3, image).when(kind == 4, P.packed((0, 2))).when(kind == 5, P.packed((4, 4), (0, 17), (9, 4))).otherwise(P.packed((8, 4), (0, 4)))
    d = _spread(spark, read(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.concat(head, fill).alias("b"))
    d = sinks.kept(d, "borders")
    f, line, border = S.fill(F.col("b"), 32), S._line(F.col("b"), 2), P.number(F.col("b"), 0, 2)
    d = d.select("p_partkey", f.alias("f"), line.alias("l"), S._named(S._bits(border, 2, 7), S.SLASHES, "NONE").alias("slash"), (S._bits(border, 8, 3) > 0).alias("crooked"))
    return d.select("p_partkey", F.concat_ws(" ", "l.type", "l.width", "l.color").alias("left"), "slash", "crooked", "f.type", F.array_join("f.colors", ",").alias("colors"), "f.style", F.array_join("f.numbers", ",").alias("numbers"), "f.status")
