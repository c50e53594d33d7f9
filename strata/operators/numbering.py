"""Numbered headings: counters on several levels that begin anew below a heading of a higher level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 7
#: Fixed values of the public format: kinds of numbers; letters and syllables in order, digits beyond them.
LETTERS = {"LATIN_CAPITAL": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "LATIN_SMALL": "abcdefghijklmnopqrstuvwxyz", "HANGUL_SYLLABLE": "가나다라마바사아자차카타파하"}
_ROMAN = (("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))


def written(n: Column, kind: str) -> Column:
    """A number from 1 as digits, letters, syllables or a Roman numeral; digits where the kind has none for it."""
    digits = n.cast("string")
    if kind in LETTERS:
        return F.when(n.between(1, len(LETTERS[kind])), F.substr(F.lit(LETTERS[kind]), n.cast("int"), F.lit(1))).otherwise(digits)
    if kind == "ROMAN_CAPITAL":
        place = [F.get(F.array(*map(F.lit, names)), F.floor(n / 10 ** (3 - i)).cast("int") % 10) for i, names in enumerate(_ROMAN)]
        return F.when(n.between(1, 3999), F.concat(*place)).otherwise(digits)
    return digits


def counters(df: DataFrame, key: str, order: str, level: str, levels: int = LEVELS, starts: tuple[int, ...] = ()) -> DataFrame:
    """df with ``counters``: for each level down to the row's own, its number; others are cut off.

    A level's number grows with each row of the level and begins anew after a row of a higher (smaller) level; it
    begins at its start, 1 where none is given. A level that was skipped has the number before its first, its
    start less one. It is a running count less what it was at the last row that reset it: two windows on
    one order, one value a level. Rows with a null level, or one out of range, count nothing and get null. Order
    values are distinct in a key.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    names = [f"_n{i}" for i in range(1, levels + 1)]
    ok = F.col(level).between(1, levels)
    seen = df.select("*", *[F.count_if(F.col(level) == i).over(w).alias(n) for i, n in enumerate(names, 1)])
    base = [F.coalesce(F.max(F.when(F.col(level).between(1, i - 1), F.col(n))).over(w), F.lit(0)) for i, n in enumerate(names, 1)]
    numbers = [F.col(n) - b + (starts[i] - 1 if i < len(starts) else 0) for i, (n, b) in enumerate(zip(names, base, strict=True))]
    return seen.withColumn("counters", F.when(ok, F.slice(F.array(*numbers), F.lit(1), F.greatest(F.col(level), F.lit(1)).cast("int")))).drop(*names)


def labels(df: DataFrame, level: str, formats: dict[int, str], kinds: dict[int, str] | None = None) -> DataFrame:
    """df with ``label``: the format of the row's level with ^1, ^2 .. filled in by the numbers of those levels.

    A level without a format has its numbers joined by points. ``kinds`` says how a level's numbers are written,
    in digits where it says nothing.
    """
    kinds = kinds or {}

    def number(i: int) -> Column:
        return written(F.get("counters", F.lit(i - 1)), kinds.get(i, "DIGIT"))

    def joined(lv: int) -> Column:
        return F.concat_ws(".", *[number(i) for i in range(1, lv + 1)])

    def filled(lv: int, text: str) -> Column:
        parts = []
        for k, piece in enumerate(text.split("^")):
            if k and piece[:1].isdigit() and 0 < int(piece[0]) <= lv:
                parts += [number(int(piece[0])), F.lit(piece[1:])]
            else:
                parts.append(F.lit(("^" if k else "") + piece))
        return F.concat(*parts)

    out = F.lit(None).cast("string")
    for lv in range(1, LEVELS + 1):
        out = F.when(F.col(level) == lv, filled(lv, formats[lv]) if lv in formats else joined(lv)).otherwise(out)
    return df.withColumn("label", F.when(F.col("counters").isNotNull(), out))
