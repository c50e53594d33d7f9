"""Trees, grids, controls, ranges, elements, shapes, numbering, bytes, published tables and file patterns against brute force."""

import random
import struct
from pathlib import PurePosixPath

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import geometry, grids, html, mining, numbering, publish, ranges, trees
from strata.sources import charsets, elements, filetree, packed, paratext


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Trees


def test_parents_and_intervals_at_any_depth(spark):
    rng = random.Random(1)
    data, want_up, want_in = [], [], []
    for key in range(12):
        stack, closed = [], {}
        levels = [rng.choice([None, *range(rng.choice([2, 40]))]) for _ in range(rng.randrange(0, 60))]
        for i, lv in enumerate(levels):
            data.append((key, i * 3, lv, f"x{i}"))
            if lv is None:
                want_up.append((key, i * 3, None, None, None))
                continue
            while stack and stack[-1][0] >= lv:
                closed[stack.pop()[1]] = last
            want_up.append((key, i * 3, stack[-1][1] if stack else None, stack[-2][1] if len(stack) > 1 else None, len(stack)))
            stack.append((lv, i * 3))
            last = i * 3
        for _, o in stack:
            closed[o] = last
        want_in += [(key, o, e) for o, e in closed.items()]
    df = spark.createDataFrame(data, "key int, at int, level int, other string").repartition(5)
    up = trees.parents(df, "key", "at", "level", up=2)
    assert rows(up, "key", "at", "parent1", "parent2", "depth") == sorted(want_up, key=repr) and "other" in up.columns
    assert rows(trees.intervals(df, "key", "at", "level"), "key", "first", "last") == sorted(want_in, key=repr)
    assert trees.intervals(df.limit(0), "key", "at", "level").collect() == trees.parents(df.limit(0), "key", "at", "level").collect() == []


def reached(links):
    out = {}
    for start in {a for a, _ in links}:
        seen, front, depth = {}, {start}, 0
        while front:
            depth += 1
            front = {b for a, b in links if a in front and b not in seen}
            seen |= dict.fromkeys(front, depth)
        out |= {(start, b): d for b, d in seen.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_any_graph(spark, seed):
    rng = random.Random(seed)
    links = {(rng.randrange(12), rng.randrange(12)) for _ in range(rng.choice([5, 14, 30]))}
    df = spark.createDataFrame([*links, *links, (3, None), (None, 4)], "child int, parent int")
    assert rows(trees.closure(df, "child", "parent"), "node", "ancestor", "depth") == sorted([(a, b, d) for (a, b), d in reached(links).items()], key=repr)


def test_closure_of_nothing_and_of_texts(spark):
    none = spark.createDataFrame([], "child string, parent string")
    assert trees.closure(none, "child", "parent").collect() == []
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c")], "child string, parent string")
    assert rows(trees.closure(loop, "child", "parent"), "node", "ancestor", "depth") == [("a", "a", 2), ("a", "b", 1), ("b", "a", 1), ("b", "b", 2), ("c", "c", 1)]


def test_what_descendants_own_goes(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (9, None)], "t int, up int")
    owned = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 11), (2, 12), (3, 12), (9, 10)], "owner int, p int")
    assert rows(trees.outside_descendants(owned, links, "owner", "p", "t", "up"), "owner", "p") == [(1, 10), (2, 11), (3, 12), (9, 10)]


# Tables in record streams


def table_body(r, c, counts, zones=0):
    return struct.pack("<IHH10x", 2 | 4, r, c) + struct.pack(f"<{len(counts)}H", *counts) + struct.pack("<HH", 7, zones) + bytes(10 * zones)


def cell_body(row, column, row_span, column_span, size=47, flags=0):
    return (struct.pack("<6xHHHHH", flags, column, row, column_span, row_span) + bytes(47))[:size]


def test_cells_captions_and_owners(spark):
    p, ctrl, li, ta = "PARA_HEADER", "CTRL_HEADER", "LIST_HEADER", "TABLE"
    stream = [
        (p, 0, b""), (ctrl, 1, b" lbt"), (li, 2, b""), (p, 2, b""), (p, 2, b""), (ta, 2, table_body(2, 3, [2, 2], 1)),
        (li, 2, cell_body(0, 0, 2, 2)), (p, 2, b""), (ctrl, 3, b""), (ta, 4, table_body(1, 1, [1])), (li, 4, cell_body(0, 0, 1, 1, 34)), (p, 4, b""), (p, 2, b""),
        (li, 2, cell_body(0, 2, 1, 9, flags=4)), (p, 2, b""), (li, 2, cell_body(5, 0, 1, 1)), (p, 2, b""), (li, 2, cell_body(1, 1, 1, 1)), (li, 2, cell_body(0, 0, 0, 1)), (li, 2, b"short"), (p, 2, b""),
        (p, 0, b""), (ctrl, 1, b""), (ta, 2, b"short"), (li, 2, cell_body(0, 0, 1, 1)),
    ]
    data = [(doc, i, *r) for doc in (5, 6) for i, r in enumerate(stream)]
    placed = grids.placed(spark.createDataFrame(data, "doc int, idx int, tag string, level int, body binary").repartition(3), "doc")
    cells = grids.cells(placed, "doc").filter("doc = 6")
    assert rows(cells, "table_at", "cell_no", "row", "column", "row_span", "column_span", "header", "paragraphs", "whole") == sorted(
        [(5, 0, 0, 0, 2, 2, False, 2, True), (5, 1, 0, 2, 1, 9, True, 2, True), (5, 2, 1, 1, 1, 1, False, 1, True), (9, 0, 0, 0, 1, 1, False, 1, False), (23, 0, 0, 0, 1, 1, False, 0, True)], key=repr
    )
    tables = grids.tables(placed, "doc").filter("doc = 5")
    got = rows(tables, "table_at", "table_no", "rows", "columns", "declared", "page_break", "repeat_header", "zones", "status", "owner_at", "owner_cell_at", "n_cells", "covered", "overlapping", "caption_paragraphs")
    assert got == sorted(
        [(5, 0, 2, 3, 4, "CELL", True, 1, "cell_count_mismatch", None, None, 3, 5, 1, 2), (9, 1, 1, 1, 1, "CELL", True, 0, "parsed", 5, 6, 1, 1, 0, 0), (23, 2, 1, 1, 1, "NONE", False, 0, "short_body", None, None, 1, 1, 0, 0)], key=repr
    )


@pytest.mark.parametrize("seed", range(4))
def test_sweep_counts_covered_places(spark, seed):
    rng = random.Random(seed)
    cells = [(t, i, rng.randrange(6), rng.randrange(7), rng.randrange(1, 5), rng.randrange(1, 5)) for t in range(5) for i in range(rng.randrange(1, 9))]
    got = grids.swept(spark.createDataFrame([(1, *c) for c in cells], "doc int, table_at int, cell_at int, row int, column int, row_span int, column_span int"), spark.createDataFrame([(1, t, 6, 7) for t in range(5)], "doc int, table_at int, rows int, columns int"), "doc")
    total = {t: set() for t in range(5)}
    spots = {}
    for t, i, r, c, rs, cs in cells:
        spots[t, i] = {(y, x) for y in range(r, min(6, r + rs)) for x in range(c, min(7, c + cs))}
        total[t] |= spots[t, i]
    first = {(t, i): (c, i) for t, i, r, c, rs, cs in cells}
    over = {k: any(o[0] == k[0] and first[o] < first[k] and spots[o] & spots[k] for o in spots) for k in spots}
    found = {(r["table_at"], r["cell_at"]): r for r in got.collect()}
    assert {k: r["overlaps"] for k, r in found.items()} == over
    assert {t: sum(r["slots"] for k, r in found.items() if k[0] == t) for t in total} == {t: len(s) for t, s in total.items()}


# Packed numbers


def test_numbers_and_bytes(spark):
    v = [0, 1, 255, 256, 65535, 2**31 - 1, 2**31, 2**32 - 1]
    df = spark.createDataFrame([(i, x, x - 2**32 if x >= 2**31 else x) for i, x in enumerate(v)], "i int, u long, s long")
    out = df.select("i", "u", "s", packed.packed((F.col("u"), 4), (F.col("s"), 4), (7, 2)).alias("b"))
    got = out.select("b", "u", "s", packed.number(F.col("b"), 0, 4).alias("x"), packed.number(F.col("b"), 4, 4, True).alias("y"), packed.number(F.col("b"), F.lit(8), 2).alias("z"), packed.number(F.col("b"), 9, 2).alias("gone"), packed.bit(F.col("u"), 31).alias("top"))
    for r in got.collect():
        assert bytes(r["b"]) == struct.pack("<IiH", r["u"], r["s"], 7)
        assert (r["x"], r["y"], r["z"], r["gone"], r["top"]) == (r["u"], r["s"], 7, None, r["u"] >= 2**31)


def test_records_of_a_batch(spark):
    rng = random.Random(3)
    bodies = [None, b"", b"x" * 6, *[rng.randbytes(rng.randrange(40)) for _ in range(30)]]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, b binary").repartition(4)
    got = {r["i"]: r for r in packed.records(df, "b", (("a", "u2"), ("c", "i4"), ("d", "u1"))).collect()}
    for i, b in enumerate(bodies):
        want = None if b is None else [struct.unpack_from("<HiB", b, k) for k in range(0, len(b) - 6, 7)]
        assert (None if got[i]["records"] is None else [tuple(r) for r in got[i]["records"]]) == want
        assert got[i]["records_rest"] == (None if b is None else len(b) % 7)


def test_line_segments_say_what_is_wrong(spark):
    one = struct.pack("<IiiiiiiiI", 5, -1, 2, 3, 4, 5, 6, 7, 2**32 - 1)
    df = spark.createDataFrame([(1, one * 2, 2), (2, one, 2), (3, one + b"z", 1), (4, None, 0), (5, b"", None)], "i int, b binary, n int")
    got = {r["i"]: r for r in packed.line_segments(df, "b", "n").collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "parsed", 2: "declared_count_mismatch", 3: "trailing_bytes", 4: None, 5: "parsed"}
    assert tuple(got[1]["segments"][1]) == (5, -1, 2, 3, 4, 5, 6, 7, 2**32 - 1)


# Controls


def tokens_of(units):
    n, i, seen, tokens, visible, to_visible = len(units), 0, 0, [], [], [0] * (len(units) + 1)
    payload = bad = 0
    text, begin, vbegin = [], 0, 0

    def flush(end):
        if text:
            s = struct.pack(f"<{len(text)}H", *text).decode("utf-16-le", "ignore")
            if s:
                tokens.append(("text", None, begin, end, vbegin, seen, s))
            visible.extend(text)
            text.clear()

    while i < n:
        c = units[i]
        if c in paratext.INLINE or c in paratext.EXTENDED:
            flush(i)
            end = min(n, i + 8)
            kind = "malformed" if end - i < 8 else "inline" if c in paratext.INLINE else "extended"
            tokens.append((kind, c, i, end, seen, seen, None))
            to_visible[i : end + 1] = [seen] * (end + 1 - i)
            bad, payload = bad + (end - i < 8), payload + 7 * (end - i == 8)
            i = end
        elif c < 32:
            flush(i)
            width = int(c in (10, 30, 31))
            tokens.append(("character", c, i, i + 1, seen, seen + width, None))
            visible += [10 if c == 10 else 32] * width
            to_visible[i], seen = seen, seen + width
            i += 1
            to_visible[i] = seen
        else:
            if not text:
                begin, vbegin = i, seen
            pair = 0xD800 <= c < 0xDC00 and i + 1 < n and 0xDC00 <= units[i + 1] < 0xE000
            text += units[i : i + 1 + pair]
            to_visible[i : i + 1 + pair] = [seen] * (1 + pair)
            i, seen = i + 1 + pair, seen + 1
            to_visible[i] = seen
    flush(n)
    return tokens, struct.pack(f"<{len(visible)}H", *visible).decode("utf-16-le", "ignore"), to_visible, payload, bad


def test_controls_in_random_units(spark):
    rng = random.Random(6)
    pool = [65, 66, 0xAC00, 0xD83D, 0xDE00, 0xD83D, 10, 30, 31, 13, 0, 24, 9, 4, 11, 2, 65, 66, 67, 68]
    bodies = [None, b"", b"A"]
    for _ in range(120):
        units = [rng.choice(pool) for _ in range(rng.randrange(40))]
        bodies.append(struct.pack(f"<{len(units)}H", *units) + b"z" * rng.randrange(2))
    got = {r["i"]: r for r in paratext.tokenized(spark.createDataFrame(list(enumerate(bodies)), "i int, b binary").repartition(3), "b").collect()}
    for i, b in enumerate(bodies):
        b = b or b""
        tokens, visible, to_visible, payload, bad = tokens_of(list(struct.unpack(f"<{len(b) // 2}H", b[: len(b) // 2 * 2])))
        r = got[i]
        assert [tuple(t) for t in r["tokens"]] == tokens
        assert (r["visible"], r["to_visible"], r["payload_units"], r["malformed"]) == (visible, to_visible, payload, bad)


# Ranges and elements


@pytest.mark.parametrize("seed", range(3))
def test_ranges_meet_their_points_once(spark, seed):
    rng = random.Random(seed)
    top = rng.choice([3, 50, 2**31 - 2])
    spans = [(k, i, rng.randrange(top), 0) for k in range(3) for i in range(25)]
    spans = [(k, i, a, min(2**31 - 2, a + rng.choice([0, 1, 5, top // 3, -1, top]))) for k, i, a, _ in spans]
    points = [(k, rng.choice([0, top, rng.randrange(top + 1)])) for k in range(4) for _ in range(20)]
    points = sorted(set(points)) + [(1, None)]
    got = ranges.within(spark.createDataFrame(points, "key int, at long"), spark.createDataFrame([*spans, (2, 99, None, 5)], "key int, name int, a long, b long"), "key", "at", "a", "b")
    want = [(k, p, i) for k, p in points if p is not None for q, i, a, b in spans if k == q and a <= p <= b]
    assert rows(got, "key", "at", "name") == sorted(want, key=repr)


def test_blocks_texts_and_losses(spark):
    xml = {
        1: "<sec><p><run><t>a &lt;b&gt; &amp;amp;</t></run><run><t>c</t></run></p></sec>",
        2: "<s:sec><hp:p><hp:run><hp:container><hp:rect><hp:pic/></hp:rect><hp:pic></hp:pic></hp:container></hp:run></hp:p><x/><!-- <p> --></s:sec>",
        3: "<sec><p></run></sec>", 4: "<sec><p></sec>", 5: "<sec/>", 6: "", 7: None, 8: "</p>", 9: "<sec><p><run><rect><tbl><tr><tc><p><pic/></p></tc></tr></tbl></rect></run></p><tbl/></sec>", 10: "<sec><a><p><run><pic/></run></p></a></sec>",
    }
    t = elements.tokens(spark.createDataFrame(list(xml.items()), "doc int, x string"), "doc", "x")
    blocks, losses = elements.section_blocks(t, elements.elements(t, "doc"), "doc")
    assert rows(blocks.withColumn("a", F.col("anchor").isNotNull()), "doc", "kind", "a", "text") == sorted(
        [(1, "paragraph", False, "a <b> &amp;c"), (2, "paragraph", False, ""), (2, "picture", True, None), (2, "picture", True, None), (9, "paragraph", False, ""), (9, "drawing", True, None), (9, "table", False, None)], key=repr
    )
    assert rows(losses, "doc", "loss", "n") == sorted([(2, "unsupported_section_child:x", 1), (3, "xml_parse_failed", 1), (4, "xml_parse_failed", 1), (8, "xml_parse_failed", 1), (10, "unsupported_section_child:a", 1)], key=repr)


def test_references_are_repaired(spark):
    given = {"": ("", 0), None: ("", 0), "a&#0;b": ("a&#xFFFD;b", 1), "&#9;&#x9;&#10;&#13;": ("&#9;&#x9;&#10;&#13;", 0), "&#xD800;&#xDFFF;&#xE000;": ("&#xFFFD;&#xFFFD;&#xE000;", 2), "&#xFFFE;&#1114111;&#1114112;": ("&#xFFFD;&#1114111;&#xFFFD;", 2), "&#00000000065;&amp;&#x;&#" + "9" * 40 + ";": ("&#00000000065;&amp;&#x;&#xFFFD;", 1)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", elements.repaired(F.col("t")).alias("r"))
    assert {r["i"]: (r["r"]["text"], r["r"]["n"]) for r in df.collect()} == dict(enumerate(given.values()))


def test_figures_in_and_out_of_figures(spark):
    pages = {"": 0, None: 0, "<figure><p></figure>": 0, "<figure><img></figure><img>": 2, "<figure><figure><svg></figure><img></figure>": 2, "<figure><img>": 1, '<div x class="a chart"><section class=\'timeline\'>': 2, '<figure class="graph"></figure>': 1, "<IMG><canvas ><imgs>": 2}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pages)], "i int, t string").select("i", html.material_figures(F.col("t")).alias("n"))
    assert {r["i"]: r["n"] for r in df.collect()} == dict(enumerate(pages.values()))


# Shapes


def test_chains_of_maps(spark):
    rng = random.Random(9)
    shapes = {i: (rng.choice([None, 77, *range(i)]) if i else None, [[rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) for _ in range(6)] for _ in range(rng.randrange(3))]) for i in range(40)}
    shapes |= {50: (51, []), 51: (50, []), 52: (51, [])}
    data = [(i, up, [(geometry.SCALE if k % 2 else "other", tuple(m)) for k, m in enumerate(ms)]) for i, (up, ms) in shapes.items()]
    df = spark.createDataFrame(data, "i int, up int, ms array<struct<kind:string,m:struct<a:double,b:double,c:double,d:double,e:double,f:double>>>")
    got = {r["i"]: r for r in geometry.placed(df.select("i", "up", geometry.composed(F.col("ms")).alias("c")).select("i", "up", "c.*"), "i", "up").collect()}
    assert set(got) == set(range(40))

    def full(ms):
        m = np.eye(3)
        for x in ms:
            m = np.array([x[:3], x[3:], [0, 0, 1]]) @ m
        return m

    for i in range(40):
        m, sx, at, depth = np.eye(3), 1.0, i, -1
        while at in shapes:
            ms = shapes[at][1]
            m, depth, root = full(ms) @ m, depth + 1, at
            for k, x in enumerate(ms):
                sx *= abs(x[0]) if k % 2 else 1
            at = shapes[at][0]
        assert np.allclose([list(got[i]["map"][:3]), list(got[i]["map"][3:])], m[:2]) and (got[i]["scale_x"], got[i]["depth"], got[i]["root"]) == (sx, depth, root)


# Numbering


def test_counters_begin_anew_below_a_higher_level(spark):
    rng = random.Random(2)
    data, want = [], {}
    for key in range(6):
        now = [0, 3, 0]
        for i in range(50):
            lv = rng.choice([None, 0, 1, 2, 2, 3, 3, 4])
            data.append((key, i, lv))
            if lv in (1, 2, 3):
                now[lv - 1] += 1
                now[lv:] = [0, 3, 0][lv:]
                want[key, i] = now[:lv]
    c = numbering.counters(spark.createDataFrame(data, "key int, i int, level int").repartition(3), "key", "i", "level", levels=3, starts=(1, 4))
    assert {(r["key"], r["i"]): r["counters"] for r in c.collect()} == {(k, i): want.get((k, i)) for k, i, _ in data}


def test_numbers_are_written_in_kinds(spark):
    df = spark.range(1, 5001).select(F.col("id").alias("n"), *[numbering.written(F.col("id"), k).alias(k) for k in ("ROMAN_CAPITAL", "LATIN_SMALL", "HANGUL_SYLLABLE", "DIGIT")])
    got = {r["n"]: r for r in df.collect()}
    assert [got[n]["ROMAN_CAPITAL"] for n in (1, 4, 9, 1994, 3999, 4000)] == ["I", "IV", "IX", "MCMXCIV", "MMMCMXCIX", "4000"]
    assert (got[26]["LATIN_SMALL"], got[27]["LATIN_SMALL"], got[14]["HANGUL_SYLLABLE"], got[15]["HANGUL_SYLLABLE"], got[7]["DIGIT"]) == ("z", "27", "하", "15", "7")


# Charsets


def test_first_charset_that_fits(spark):
    data = [(1, "가나 é".encode(), None), (2, "가나".encode("cp949"), None), (3, "똠방".encode("cp949"), "euc-kr"), (4, b"\xff\xfe\x41", None), (5, "é".encode("latin-1") + b"!", "no-such"), (6, "x".encode("utf-16-le"), "UTF-16LE"), (7, None, "utf-8"), (8, b"", None), (9, b"abc", "hex"), (10, b"\x00\xd8", "utf-16-le")]
    got = {r["i"]: (r["text"], r["charset"]) for r in charsets.decoded(spark.createDataFrame(data, "i int, b binary, n string"), "b", "n").collect()}
    assert got == {1: ("가나 é", "utf-8"), 2: ("가나", "cp949"), 3: ("똠방", "cp949"), 4: ("ÿþA", "latin-1"), 5: ("é!", "latin-1"), 6: ("x", "UTF-16LE"), 7: (None, None), 8: ("", "utf-8"), 9: ("abc", "utf-8"), 10: ("\x00Ø", "latin-1")}
    plain = spark.createDataFrame([(1, b"abc"), (2, None), (3, b"\xff")], "i int, b binary")
    assert {r["i"]: (r["text"], r["charset"]) for r in charsets.decoded(plain, "b", charsets=("utf-8",)).collect()} == {1: ("abc", "utf-8"), 2: (None, None), 3: ("�", "replaced")}
    types = spark.createDataFrame([(1, 'text/html; charset="EUC-KR"; q'), (2, "text/html"), (3, None), (4, "CharSet=utf-8")], "i int, t string")
    assert {r["i"]: r["c"] for r in types.select("i", charsets.declared(F.col("t")).alias("c")).collect()} == {1: "EUC-KR", 2: None, 3: None, 4: "utf-8"}


# Published tables and files


def test_a_failed_write_leaves_what_was_published(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert publish.manifest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        publish.current(spark, root)
    a = spark.range(10).withColumn("x", F.lit("a"))
    broken = a.withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise("b"))
    with pytest.raises(Exception, match="no"):
        publish.publish(broken, root)
    assert publish.manifest(spark, root) is None
    first = publish.publish(a, root)
    with pytest.raises(Exception, match="no"):
        publish.publish(broken, root)
    assert publish.current(spark, root).count() == 10 and publish.manifest(spark, root)["version"] == first["version"]
    second = publish.publish(a.limit(0), root)
    third = publish.publish(a.withColumn("y", F.lit(1)), root)
    assert publish.current(spark, root).columns == ["id", "x", "y"] and third["previous"] == second["version"]
    assert publish.prune(spark, root) == 1 and publish.prune(spark, root) == 0
    assert rows(publish.events(spark, root), "event", "state", "rows_before", "rows_after") == [(1, "failed", 0, 0), (1, "published", 0, 10), (2, "failed", 10, 10), (3, "published", 10, 0), (4, "published", 0, 10)]


def test_globs_are_those_of_paths(spark):
    patterns = ["*.txt", "a/*", "a/**/*.txt", "**/*.csv", "?/b[0-3].txt", "a/[!b]*", "**/c/*", "x.y+(z)/*", "a/b"]
    paths = ["a.txt", "a/b", "a/b.txt", "a/b/c.txt", "a/b/c/d.txt", "q.csv", "a/b/q.csv", "z/b2.txt", "z/b4.txt", "c/d", "a/c/d", "x.y+(z)/f", "xay(z)/f", "a/^b"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", *[F.col("path").rlike(filetree.glob(g)).alias(f"g{i}") for i, g in enumerate(patterns)])
    for r in df.collect():
        assert [r[f"g{i}"] for i in range(len(patterns))] == [PurePosixPath(r["path"]).full_match(g) for g in patterns], r["path"]


def test_files_count_once_and_required_ones_are_missed(spark, tmp_path):
    for name in ("a/x.txt", "a/b/y.txt", "z.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    files = filetree.listing(spark, f"file://{tmp_path}")
    assert rows(files, "path", "size") == [("a/b/y.txt", 9), ("a/x.txt", 7), ("z.csv", 5)]
    odd = files.select("path").union(spark.createDataFrame([("./a//x.txt",), ("a/q/../x.txt",), ("../z.csv",)], "path string"))
    got = filetree.named(odd, [("one", "a/*.txt", True), ("all", "**/*.txt", True), ("none", "*.pdf", True), ("maybe", "*.png", False)])
    assert rows(got, "role", "place", "path", "required", "present") == [("all", 0, "a/b/y.txt", True, True), ("none", 0, "*.pdf", True, False), ("one", 0, "a/x.txt", True, True)]


def test_files_are_written_by_many_tasks(spark, tmp_path):
    df = spark.createDataFrame([(k, n, f"{k}{n}") for k in "ab" for n in range(40)] + [("a", 3, None)], "kind string, n int, value string").coalesce(1)
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("written", "")
    filetree.written(df, f"file://{tmp_path}/t", ["kind", "n"], "value")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in seen.getJobIdsForGroup("written") for s in seen.getJobInfo(j).stageIds]
    assert max(seen.getStageInfo(s).numTasks for s in stages) == 4 * spark.sparkContext.defaultParallelism
    got = {str(p.parent.relative_to(tmp_path / "t")): sorted(p.read_text().splitlines()) for p in (tmp_path / "t").rglob("*") if p.is_file() and p.suffix == ".txt"}
    assert got == {f"kind={k}/n={n}": ["", "a3"] if (k, n) == ("a", 3) else [f"{k}{n}"] for k in "ab" for n in range(40)}


# Mined rules


def test_rules_by_producer_and_missing_counts(spark):
    rules = (("r1", "high", "a.b", "c", None), ("r2", "low", "x.layout_control_child_counts.q", "section_ctrl_child_counts.q", None), ("r3", "low", "a.b", "c", "one"))
    pairs = spark.createDataFrame([(1, "one"), (2, None), (3, "two")], "pair int, producer string")
    profiles = spark.createDataFrame([(1, "source", "a.b", "10"), (1, "target", "c", "12"), (2, "source", "a.b", "x"), (2, "target", "c", "1"), (3, "source", "a.b", "0"), (3, "target", "c", "9"), (3, "target", "section_ctrl_child_counts.q", "4"), (9, "source", "a.b", "1")], "pair int, side string, path string, value string")
    o = mining.observations(pairs, profiles, rules)
    assert rows(o, "pair", "rule_id", "relation", "delta") == sorted(
        [(1, "r1", "close", 2), (2, "r1", "missing_signal", None), (3, "r1", "target_only", 9), (1, "r2", "exact", 0), (2, "r2", "exact", 0), (3, "r2", "target_only", 4), (1, "r3", "close", 2), (2, "r3", "not_applicable", None), (3, "r3", "not_applicable", None)], key=repr
    )
    assert rows(mining.report(o), "rule_id", "compared", "score", "band", "deltas") == [("r1", 2, 0.35, "exploratory", "2,9"), ("r2", 3, 0.6667, "weak_signal", "0,0,4"), ("r3", 1, 0.7, "weak_signal", "2")]
    assert len({r[0] for r in mining.RULES}) == len(mining.RULES) == 42


def test_rules_whose_path_has_one_part_and_is_lacking(spark):
    rules = (("r1", "high", "a", "c", None), ("r2", "low", "section_ctrl_child_counts", "layout_control_child_counts.q", None))
    pairs = spark.createDataFrame([(1, None), (2, None)], "pair int, producer string")
    profiles = spark.createDataFrame([(1, "target", "c", "2")], "pair int, side string, path string, value string")
    o = mining.observations(pairs, profiles, rules)
    assert rows(o, "pair", "rule_id", "source_value", "target_value", "relation") == sorted([(1, "r1", None, 2, "missing_signal"), (2, "r1", None, None, "missing_signal"), (1, "r2", None, 0, "missing_signal"), (2, "r2", None, 0, "missing_signal")], key=repr)
