"""Style records: shapes of characters and paragraphs, borders and fills, decoded from packed bodies as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.sources.packed import bit, number, once

#: Fixed values of the public format: names by code, and how long bodies are at least.
LANGUAGES = 7
LINE_SHAPES = ("SOLID", "DASH", "DOT", "DASH_DOT", "DASH_DOT_DOT", "LONG_DASH", "CIRCLE", "DOUBLE_SLIM", "SLIM_THICK", "THICK_SLIM", "SLIM_THICK_SLIM", "WAVE", "DOUBLE_WAVE", "THICK_3D", "THICK_3D_REVERSE_LIGHT", "3D", "3D_REVERSE_LIGHT")
OUTLINES = ("NONE", "SOLID", "DOT", "THICK", "DASH", "DASH_DOT", "DASH_DOT_DOT")
SHADOWS = ("NONE", "DROP", "CONTINUOUS")
MARKS = ("NONE", "DOT_ABOVE", "RING_ABOVE", "CARON", "TILDE", "MIDDLE_DOT", "COLON")
UNDERLINES = ("NONE", "BOTTOM", "NONE", "TOP")
HORIZONTAL = ("JUSTIFY", "LEFT", "RIGHT", "CENTER", "DISTRIBUTE", "DISTRIBUTE")
VERTICAL = ("BASELINE", "TOP", "CENTER", "BOTTOM")
HEADINGS = ("NONE", "OUTLINE", "NUMBER", "BULLET")
SPACINGS = ("PERCENT", "FIXED", "BETWEEN_LINES", "AT_LEAST")
WRAPS = ("BREAK", "SQUEEZE", "KEEP")
LATIN_BREAKS = ("KEEP_WORD", "HYPHENATION", "BREAK_WORD")
LINES = ("NONE", "SOLID", "DOT", "DASH", "DASH_DOT", "DASH_DOT_DOT", "LONG_DASH", "CIRCLE", "DOUBLE_SLIM", "SLIM_THICK", "THICK_SLIM", "SLIM_THICK_SLIM", "WAVE", "DOUBLE_WAVE", "THICK_3D", "THICK_3D_REV", "SOLID_3D", "SOLID_3D_REV")
WIDTHS = ("0.1", "0.12", "0.15", "0.2", "0.25", "0.3", "0.4", "0.5", "0.6", "0.7", "1.0", "1.5", "2.0", "3.0", "4.0", "5.0")
SLASHES = ("NONE", "NONE", "CENTER", "CENTER_BELOW", "NONE", "NONE", "CENTER_ABOVE", "ALL")
HATCHES = (None, "HORIZONTAL", "VERTICAL", "BACK_SLASH", "CROSS", "CROSS_DIAGONAL", "CROSS_DIAGONAL")
GRADATIONS = ("LINEAR", "LINEAR", "RADIAL", "CONICAL", "SQUARE")
MODES = ("TILE", "TILE_HORZ_TOP", "TILE_HORZ_BOTTOM", "TILE_VERT_LEFT", "TILE_VERT_RIGHT", "TOTAL", "CENTER", "CENTER_TOP", "CENTER_BOTTOM", "LEFT_CENTER", "LEFT_TOP", "LEFT_BOTTOM", "RIGHT_CENTER", "RIGHT_TOP", "RIGHT_BOTTOM", "NONE")
EFFECTS = ("REAL_PIC", "GRAY_SCALE", "BLACK_WHITE", "REAL_PIC", "PATTERN8X8")
CHAR_BYTES, PARA_BYTES, PARA_WHOLE, BORDER_BYTES = 68, 42, 54, 36


def _bits(flags: Column, shift: int, mask: int) -> Column:
    return F.shiftright(flags, shift).bitwiseAND(F.lit(mask))


def _named(code: Column, names: tuple, other: str | None) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), code.cast("int")), F.lit(other))


def colour(body: Column, at: int | Column, none: bool = False, alpha: bool = False) -> Column:
    """#RRGGBB of three bytes, with a leading alpha if it is asked for and not 0; beyond the end black, or none where that is allowed."""
    at = F.lit(at) if isinstance(at, int) else at
    rgb = F.hex(F.substring(body, at + 1, F.lit(3)))
    value = number(body, at, 4)
    text = F.concat(F.lit("#"), rgb)
    if alpha:
        text = F.when(value >= 1 << 24, F.concat(F.lit("#"), F.hex(F.substring(body, at + 4, F.lit(1))), rgb)).otherwise(text)
    if none:
        return F.when(value.isNull() | (value == 0xFFFFFFFF), "none").otherwise(text)
    return F.when(value.isNull(), "#000000").otherwise(text)


def char_shape(b: Column) -> Column:
    """The character shape that a body packs; null with a body too short for one."""
    return F.when(F.octet_length(b) >= CHAR_BYTES, once(number(b, 46, 4), lambda a: _char_shape(b, a)))


def _char_shape(b: Column, a: Column) -> Column:
    each = lambda at, width, signed=False: F.array(*[number(b, at + i * width, width, signed) for i in range(LANGUAGES)])
    underline, strike = _bits(a, 2, 3), _bits(a, 18, 7)
    under = _named(underline, UNDERLINES, "NONE")
    lined = under != "NONE"
    return F.struct(
        each(0, 2).alias("font_ref"), each(14, 1).alias("ratio"), each(21, 1, True).alias("spacing"), each(28, 1).alias("relative_size"), each(35, 1, True).alias("offset"), F.greatest(F.lit(0), number(b, 42, 4, True)).alias("height"),
        colour(b, 52).alias("text_color"), colour(b, 60, none=True).alias("shade_color"), bit(a, 25).alias("use_font_space"), bit(a, 30).alias("use_kerning"), _named(_bits(a, 21, 15), MARKS, "NONE").alias("sym_mark"), F.coalesce(number(b, 68, 2), F.lit(0)).alias("border_fill_id"),
        bit(a, 0).alias("italic"), bit(a, 1).alias("bold"), bit(a, 13).alias("emboss"), bit(a, 14).alias("engrave"), bit(a, 15).alias("superscript"), bit(a, 16).alias("subscript"), under.alias("underline"),
        F.when(lined, _named(_bits(a, 4, 15), LINE_SHAPES, "SOLID")).otherwise("SOLID").alias("underline_shape"), F.when(lined, colour(b, 56)).otherwise("#000000").alias("underline_color"), F.when(strike > 0, _named(_bits(a, 26, 15), LINE_SHAPES, "SOLID")).otherwise("NONE").alias("strikeout"),
        F.when(F.octet_length(b) >= 74, colour(b, 70, none=True)).otherwise("#000000").alias("strikeout_color"), _named(_bits(a, 8, 7), OUTLINES, "NONE").alias("outline"), _named(_bits(a, 11, 3), SHADOWS, "NONE").alias("shadow"), colour(b, 64).alias("shadow_color"),
        number(b, 50, 1, True).alias("shadow_x"), number(b, 51, 1, True).alias("shadow_y"),
    )


def para_shape(b: Column) -> Column:
    """The paragraph shape that a body packs; null with a body too short for one. Fields added by later versions are 0 where they lack."""
    flags = F.struct(number(b, 0, 4).alias("a"), F.coalesce(number(b, 42, 4), F.lit(0)).alias("a2"), F.coalesce(number(b, 46, 4), F.lit(0)).alias("a3"), number(b, 30, 2).alias("numbering"))
    return F.when(F.octet_length(b) >= PARA_BYTES, once(flags, lambda f: _para_shape(b, f["a"], f["a2"], f["a3"], f["numbering"])))


def _para_shape(b: Column, a: Column, a2: Column, a3: Column, numbering: Column) -> Column:
    heading = _bits(a, 23, 3)
    margins = [number(b, 4 + 4 * i, 4, True).alias(n) for i, n in enumerate(("left", "right", "indent", "prev", "next"))]
    offsets = [number(b, 34 + 2 * i, 2, True).alias(f"border_{n}") for i, n in enumerate(("left", "right", "top", "bottom"))]
    flags = {"font_line_height": 22, "snap_to_grid": 8, "widow_orphan": 16, "keep_with_next": 17, "keep_lines": 18, "page_break_before": 19, "border_connect": 28, "border_ignore_margin": 29}
    return F.struct(
        number(b, 28, 2).alias("tab_id"), _bits(a, 9, 127).alias("condense"), _named(_bits(a, 2, 7), HORIZONTAL, "JUSTIFY").alias("horizontal"), _named(_bits(a, 20, 3), VERTICAL, "BASELINE").alias("vertical"), _named(heading, HEADINGS, "NONE").alias("heading"),
        F.when((heading == 0) | (numbering == 0xFFFF), 0).otherwise(numbering).alias("heading_ref"), _bits(a, 25, 7).alias("heading_level"), _named(_bits(a, 5, 3), LATIN_BREAKS, "KEEP_WORD").alias("break_latin"), F.when(bit(a, 7), "KEEP_WORD").otherwise("BREAK_WORD").alias("break_other"),
        *[bit(a, n).alias(k) for k, n in flags.items()], _named(_bits(a2, 0, 3), WRAPS, "BREAK").alias("line_wrap"), bit(a2, 4).alias("space_latin"), bit(a2, 5).alias("space_numbers"), *margins, number(b, 32, 2).alias("border_fill_id"), *offsets,
        _named(_bits(a3, 0, 31), SPACINGS, "PERCENT").alias("line_spacing_type"), F.coalesce(number(b, 50, 4), F.greatest(F.lit(0), number(b, 24, 4, True))).alias("line_spacing"), F.greatest(F.lit(0), F.octet_length(b) - PARA_WHOLE).alias("extension_bytes"),
    )


def _line(b: Column, at: int) -> Column:
    return F.struct(_named(number(b, at, 1), LINES, "NONE").alias("type"), F.concat(_named(number(b, at + 1, 1), WIDTHS, "0.1"), F.lit(" mm")).alias("width"), colour(b, at + 2, none=True).alias("color"))


def fill(b: Column, at: int) -> Column:
    """(type, colors, style, numbers, alpha, end, status) of a fill: none, solid, gradation or image, where it ends in the body and whether it was cut short.

    numbers are a gradation's angle, centre, step and step centre, an image's brightness, contrast and binary item.
    """
    kind, size, c = number(b, at, 4), F.octet_length(b), F.lit(at + 4)
    texts, longs = "array<string>", "array<bigint>"

    def made(name, end, status="parsed", colors=None, style=None, numbers=None, alpha=None):
        return F.struct(
            F.lit(name).alias("type"), (F.array().cast(texts) if colors is None else colors).alias("colors"), (F.lit(None).cast("string") if style is None else style).alias("style"), (F.array().cast(longs) if numbers is None else F.array(*numbers).cast(longs)).alias("numbers"),
            (F.lit(None).cast("long") if alpha is None else alpha.cast("long")).alias("alpha"), end.cast("long").alias("end"), (F.lit(status) if isinstance(status, str) else status).alias("status"),
        )

    def extra(start: Column):
        """Where bytes added by later versions end, whether they are whole, and how many they are."""
        n = number(b, start, 4)
        whole = n.isNotNull() & (start + 4 + n <= size)
        return F.when(whole, start + 4 + n).otherwise(size), whole, F.coalesce(n, F.lit(0))

    cut = lambda name, status: made(name, size, status)
    state = lambda whole: F.when(whole, "parsed").otherwise("truncated_extra_fill")
    # solid: alpha is the last of the added bytes, or a byte of its own after none
    end, whole, n = extra(c + 12)
    tail = F.coalesce(number(b, end, 1), F.lit(0))
    pattern = number(b, c + 8, 4, True)
    started = F.when(whole, n > 0).otherwise(c + 16 < size)
    alpha = F.when(started, number(b, F.when(whole, end).otherwise(size) - 1, 1)).otherwise(tail)
    solid = made("solid", F.when(~started & (end < size), end + 1).otherwise(end), state(whole), F.array(colour(b, c, none=True), colour(b, c + 4, none=True, alpha=True)), F.when(pattern >= 0, _named(pattern, HATCHES, None)), alpha=alpha)
    # gradation: places only for more than two colours
    count = F.greatest(F.lit(0), number(b, c + 17, 4, True))
    first = c + 21 + F.when(count > 2, count * 4).otherwise(0)
    end, whole, n = extra(first + count * 4)
    centre = F.coalesce(F.when((whole & (n > 0)) | (~whole & (first + count * 4 + 4 < size)), number(b, first + count * 4 + 4, 1)), F.lit(50))
    many = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), count - 1).cast("int")), lambda i: colour(b, first + i * 4))).otherwise(F.array().cast(texts))
    numbers = [number(b, c + 1, 4, True), number(b, c + 5, 4, True), number(b, c + 9, 4, True), number(b, c + 13, 4, True), centre]
    gradation = made("gradation", F.when(end < size, end + 1).otherwise(end), state(whole), many, _named(number(b, c, 1), GRADATIONS, "LINEAR"), numbers, F.coalesce(number(b, end, 1), F.lit(0)))
    gradation = F.when(c + 21 > size, cut("gradation", "truncated_gradation_fill")).when((count > 2) & (c + 21 + count * 4 > size), cut("gradation", "truncated_gradation_positions")).when(first + count * 4 > size, cut("gradation", "truncated_gradation_colors")).otherwise(gradation)
    end, whole, _ = extra(c + 6)
    numbers = [number(b, c + 1, 1, True), number(b, c + 2, 1, True), number(b, c + 4, 2)]
    style = F.concat_ws("/", _named(number(b, c, 1), MODES, "FIT_SIZE"), _named(number(b, c + 3, 1), EFFECTS, "REAL_PIC"))
    image = F.when(c + 6 > size, cut("image", "truncated_image_fill")).otherwise(made("image", F.when(end < size, end + 1).otherwise(end), state(whole), None, style, numbers, F.coalesce(number(b, end, 1), F.lit(0))))
    return (
        F.when(kind.isNull(), cut("none", "truncated_fill_type")).when(kind == 0, made("none", F.least(size, c + 4))).when(bit(kind, 0), F.when(c + 12 > size, cut("solid", "truncated_solid_fill")).otherwise(solid))
        .when(bit(kind, 2), gradation).when(bit(kind, 1), image).otherwise(cut("unsupported", "unsupported_fill_type"))
    )


def border_fill(b: Column) -> Column:
    """Borders, slashes and fill that a body packs, with a status; null with a body too short for one."""
    a, f = number(b, 0, 2), fill(b, 32)
    slash = lambda code, crooked, counter: F.struct(_named(code, SLASHES, "NONE").alias("type"), crooked.alias("crooked"), counter.alias("counter"))
    diagonal = _line(b, 26)
    shape = F.struct(
        bit(a, 0).alias("three_d"), bit(a, 1).alias("shadow"), F.when(bit(a, 13), "CENTER").otherwise("NONE").alias("center_line"), bit(a, 14).alias("separate"), slash(_bits(a, 2, 7), _bits(a, 8, 3) > 0, bit(a, 11)).alias("slash"), slash(_bits(a, 5, 7), bit(a, 10), bit(a, 12)).alias("back_slash"),
        *[_line(b, 2 + 6 * i).alias(n) for i, n in enumerate(("left", "right", "top", "bottom"))], F.when(diagonal["type"] != "NONE", diagonal).alias("diagonal"), f.alias("fill"),
    )
    return F.when(F.octet_length(b) >= BORDER_BYTES, shape)


def numbered(records: DataFrame, key: str, order: str, tags: dict[str, object], first: dict[str, int] | None = None) -> DataFrame:
    """Records of the named tags with ``id``, their number among those of their tag and key; ids begin at 0 or where ``first`` says."""
    w = Window.partitionBy(key, "tag").orderBy(order)
    start = F.coalesce(*[F.when(F.col("tag") == t, n) for t, n in (first or {}).items()], F.lit(0))
    return records.filter(F.col("tag").isin(*tags)).withColumn("id", F.row_number().over(w) - 1 + start)
