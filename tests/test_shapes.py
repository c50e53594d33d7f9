"""Style records against a decoder written byte by byte."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from strata.sources import shapes as S


def pick(names, code, other):
    return names[code] if 0 <= code < len(names) else other


def colour(b, at, none=False, alpha=False):
    if at + 4 > len(b):
        return "none" if none else "#000000"
    if none and b[at : at + 4] == b"\xff" * 4:
        return "none"
    rgb = b[at : at + 3].hex().upper()
    return f"#{b[at + 3]:02X}{rgb}" if alpha and b[at + 3] else f"#{rgb}"


def fill(b, at):
    def i32(k):
        return struct.unpack_from("<i", b, k)[0]

    def extra(k):
        if k + 4 > len(b):
            return False, len(b), b""
        n = struct.unpack_from("<I", b, k)[0]
        return k + 4 + n <= len(b), min(len(b), k + 4 + n), b[k + 4 : k + 4 + n]

    cut = lambda t, s: (t, [], None, [], None, len(b), s)
    done = lambda ok: "parsed" if ok else "truncated_extra_fill"
    if at + 4 > len(b):
        return cut("none", "truncated_fill_type")
    kind, c = struct.unpack_from("<I", b, at)[0], at + 4
    if kind == 0:
        return "none", [], None, [], None, min(len(b), c + 4), "parsed"
    if kind & 1:
        if c + 12 > len(b):
            return cut("solid", "truncated_solid_fill")
        ok, end, more = extra(c + 12)
        alpha = more[-1] if more else b[end] if end < len(b) else 0
        p = i32(c + 8)
        return "solid", [colour(b, c, True), colour(b, c + 4, True, True)], pick(S.HATCHES, p, None), [], alpha, end + (not more and end < len(b)), done(ok)
    if kind & 4:
        if c + 21 > len(b):
            return cut("gradation", "truncated_gradation_fill")
        n = max(0, i32(c + 17))
        k = c + 21
        if n > 2:
            k += 4 * n
            if k > len(b):
                return cut("gradation", "truncated_gradation_positions")
        if k + 4 * n > len(b):
            return cut("gradation", "truncated_gradation_colors")
        ok, end, more = extra(k + 4 * n)
        return "gradation", [colour(b, k + 4 * i) for i in range(n)], pick(S.GRADATIONS, b[c], "LINEAR"), [i32(c + 1), i32(c + 5), i32(c + 9), i32(c + 13), more[0] if more else 50], b[end] if end < len(b) else 0, end + (end < len(b)), done(ok)
    if kind & 2:
        if c + 6 > len(b):
            return cut("image", "truncated_image_fill")
        ok, end, _ = extra(c + 6)
        v = struct.unpack_from("<BbbBH", b, c)
        return "image", [], f"{pick(S.MODES, v[0], 'FIT_SIZE')}/{pick(S.EFFECTS, v[3], 'REAL_PIC')}", [v[1], v[2], v[4]], b[end] if end < len(b) else 0, end + (end < len(b)), done(ok)
    return cut("unsupported", "unsupported_fill_type")


def fills():
    rng = random.Random(4)
    out = [b"", b"\0\0\0", struct.pack("<I", 0), struct.pack("<II", 0, 0) + b"x", struct.pack("<I", 8) + b"abc"]
    for _ in range(60):
        colours = rng.randrange(5)
        more = rng.randbytes(rng.randrange(3))
        ending = struct.pack("<I", len(more)) + more + rng.randbytes(rng.randrange(3))
        out.append(struct.pack("<IIIi", 1, rng.choice([0xFFFFFFFF, 0xFF0010, 0x80102030]), rng.choice([0xFFFFFFFF, 0x80102030, 5]), rng.randrange(-1, 9)) + ending)
        out.append(struct.pack("<IB5i", 4, rng.randrange(6), -30, 50, 60, 9, colours) + rng.randbytes(4 * colours * (2 if colours > 2 else 1)) + ending)
        out.append(struct.pack("<IBbbBH", 2, rng.randrange(18), -5, 7, rng.randrange(6), 300) + ending)
    return out + [x[: rng.randrange(len(x))] for x in out[5:] for _ in range(2)] + [x[:-1] for x in out[5:]]


def test_borders_and_fills(spark):
    rng = random.Random(5)
    bodies = [rng.randbytes(2) + bytes([rng.randrange(20), rng.randrange(18)]) + rng.choice([b"\xff" * 4, rng.randbytes(4)]) + rng.randbytes(18) + bytes([rng.randrange(3), 3]) + rng.randbytes(4) + f for f in fills()]
    df = spark.createDataFrame([*enumerate(bodies), (-1, b"short"), (-2, None)], "i int, b binary").select("i", S.border_fill(F.col("b")).alias("s"), S.fill(F.col("b"), 32).alias("f"))
    for r in df.collect():
        if r["i"] < 0:
            assert r["s"] is None
            continue
        b, a = bodies[r["i"]], struct.unpack_from("<H", bodies[r["i"]])[0]
        want = fill(b, 32)
        assert tuple(r["f"]) == want, (b[32:].hex(), r["f"], want)
        assert (r["s"] is None) == (len(b) < 36)
        if r["s"]:
            s = r["s"]
            line = lambda at: (pick(S.LINES, b[at], "NONE"), pick(S.WIDTHS, b[at + 1], "0.1") + " mm", colour(b, at + 2, True))  # noqa: B023,E731
            assert [tuple(s[n]) for n in ("left", "right", "top", "bottom")] == [line(2 + 6 * i) for i in range(4)]
            assert (None if s["diagonal"] is None else tuple(s["diagonal"])) == (None if line(26)[0] == "NONE" else line(26)) and tuple(s["fill"]) == want
            assert (s["three_d"], s["shadow"], s["center_line"], s["separate"]) == (bool(a & 1), bool(a & 2), "CENTER" if a >> 13 & 1 else "NONE", bool(a >> 14 & 1))
            assert tuple(s["slash"]) == (S.SLASHES[a >> 2 & 7], bool(a >> 8 & 3), bool(a >> 11 & 1)) and tuple(s["back_slash"]) == (S.SLASHES[a >> 5 & 7], bool(a >> 10 & 1), bool(a >> 12 & 1))


@pytest.mark.parametrize("size", [67, 68, 69, 70, 73, 74, 80])
def test_character_shapes(spark, size):
    rng = random.Random(size)
    bodies = [rng.randbytes(size) for _ in range(40)] + [b"\xff" * size, b"\0" * size]
    for i, r in enumerate(spark.createDataFrame(list(enumerate(bodies)), "i int, b binary").select("i", S.char_shape(F.col("b")).alias("s")).orderBy("i").collect()):
        b, s = bodies[i], r["s"]
        if size < 68:
            assert s is None
            continue
        a = struct.unpack_from("<I", b, 46)[0]
        lists = [list(struct.unpack_from(f, b, at)) for f, at in (("<7H", 0), ("<7B", 14), ("<7b", 21), ("<7B", 28), ("<7b", 35))]
        assert [s["font_ref"], s["ratio"], s["spacing"], s["relative_size"], s["offset"]] == lists and s["height"] == max(0, struct.unpack_from("<i", b, 42)[0])
        under = S.UNDERLINES[a >> 2 & 3]
        assert (s["text_color"], s["shade_color"], s["shadow_color"]) == (colour(b, 52), colour(b, 60, True), colour(b, 64)) and s["sym_mark"] == pick(S.MARKS, a >> 21 & 15, "NONE")
        assert (s["underline"], s["underline_shape"], s["underline_color"]) == ((under, pick(S.LINE_SHAPES, a >> 4 & 15, "SOLID"), colour(b, 56)) if under != "NONE" else ("NONE", "SOLID", "#000000"))
        assert s["strikeout"] == (pick(S.LINE_SHAPES, a >> 26 & 15, "SOLID") if a >> 18 & 7 else "NONE") and s["strikeout_color"] == (colour(b, 70, True) if size >= 74 else "#000000")
        assert s["border_fill_id"] == (struct.unpack_from("<H", b, 68)[0] if size >= 70 else 0) and (s["outline"], s["shadow"]) == (pick(S.OUTLINES, a >> 8 & 7, "NONE"), pick(S.SHADOWS, a >> 11 & 3, "NONE"))
        assert [s[n] for n in ("italic", "bold", "emboss", "engrave", "superscript", "subscript", "use_font_space", "use_kerning")] == [bool(a >> k & 1) for k in (0, 1, 13, 14, 15, 16, 25, 30)] and (s["shadow_x"], s["shadow_y"]) == struct.unpack_from("<bb", b, 50)


@pytest.mark.parametrize("size", [41, 42, 46, 50, 54, 58])
def test_paragraph_shapes(spark, size):
    rng = random.Random(size)
    bodies = [rng.randbytes(size) for _ in range(40)] + [b"\xff" * size, b"\0" * size]
    for i, r in enumerate(spark.createDataFrame(list(enumerate(bodies)), "i int, b binary").select("i", S.para_shape(F.col("b")).alias("s")).orderBy("i").collect()):
        b, s = bodies[i], r["s"]
        if size < 42:
            assert s is None
            continue
        u32 = lambda at: struct.unpack_from("<I", b, at)[0] if at + 4 <= size else None  # noqa: B023,E731
        a, a2, a3 = u32(0), u32(42) or 0, u32(46) or 0
        tab, ref, border = struct.unpack_from("<3H", b, 28)
        six = struct.unpack_from("<6i", b, 4)
        assert (s["left"], s["right"], s["indent"], s["prev"], s["next"]) == six[:5] and [s[f"border_{n}"] for n in ("left", "right", "top", "bottom")] == list(struct.unpack_from("<4h", b, 34))
        assert (s["tab_id"], s["border_fill_id"], s["condense"], s["heading_level"]) == (tab, border, a >> 9 & 127, a >> 25 & 7) and s["heading_ref"] == (0 if a >> 23 & 3 == 0 or ref == 0xFFFF else ref)
        assert (s["horizontal"], s["vertical"], s["heading"], s["line_wrap"], s["line_spacing_type"]) == (pick(S.HORIZONTAL, a >> 2 & 7, "JUSTIFY"), S.VERTICAL[a >> 20 & 3], S.HEADINGS[a >> 23 & 3], pick(S.WRAPS, a2 & 3, "BREAK"), pick(S.SPACINGS, a3 & 31, "PERCENT"))
        assert (s["break_latin"], s["break_other"]) == (pick(S.LATIN_BREAKS, a >> 5 & 3, "KEEP_WORD"), "KEEP_WORD" if a >> 7 & 1 else "BREAK_WORD") and s["line_spacing"] == (u32(50) if size >= 54 else max(0, six[5])) and s["extension_bytes"] == max(0, size - 54)
        assert [s[n] for n in ("font_line_height", "snap_to_grid", "widow_orphan", "keep_with_next", "keep_lines", "page_break_before", "border_connect", "border_ignore_margin", "space_latin", "space_numbers")] == [bool(a >> k & 1) for k in (22, 8, 16, 17, 18, 19, 28, 29)] + [bool(a2 >> k & 1) for k in (4, 5)]
