"""Texts with Hangul and markup: cue tokens, compatible forms, fields, tables, sections and character references."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.batches import slices
from strata.functions.shipping import ship

#: Endings that a cue token loses, tried one after another in this order.
ENDINGS = ("처럼", "같이", "같은", "에게", "으로", "로", "하게", "하게끔", "답게", "형", "문서")
#: What stands for no value.
NO_VALUE = ("", "n/a", "na", "none", "null", "undecided", "미정")


def cue_tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct tokens of Latin letters, digits and Hangul in lower case, without endings, of two characters or more."""

    def bare(t: Column) -> Column:
        out = t
        for e in ENDINGS:  # two characters at least stay before an ending
            out = F.regexp_replace(out, f"^(.{{2,}}){e}$", "$1")
        # a token changes only if its last character is that of an ending
        return F.when(F.substring(t, -1, 1).isin(*sorted({e[-1] for e in ENDINGS})), out).otherwise(t)

    # distinct before the endings are taken off, which is done once for each
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[0-9a-z가-힣]+"), 0))
    found = F.array_distinct(F.filter(F.transform(found, bare), lambda t: F.length(t) >= 2))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def compatible(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, plain): texts after NFKC normalisation, without any white space; a null is empty."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def apply(batches):
        for batch in slices(batches, 2 << 20, text):
            plain = ["".join(unicodedata.normalize("NFKC", t or "").split()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.string())], names=[key, "plain"])

    return df.select(key, text).mapInArrow(apply, f"{key} {kind}, plain string")


def _lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\r\n|\n|\r")


def table_length(c: Column) -> Column:
    """Rows of a text's pipe tables without rules, less one for the header, at least 0."""
    rows = F.filter(F.transform(_lines(c), F.trim), lambda x: x.startswith("|") & x.endswith("|") & ~x.rlike(r"^[|:\- ]*$"))
    return F.greatest(F.lit(0), F.size(rows) - 1).cast("long")


def field(c: Column, names: tuple[str, ...]) -> Column:
    """The value of the first line ``name: value`` that has one; empty without such a line."""
    pattern = r"(?i)^\s*(?:[-*]\s*)?`?(?:" + "|".join(names) + r")`?\s*:(.*)$"
    values = F.transform(F.filter(_lines(c), lambda x: x.rlike(pattern)), lambda x: F.trim(F.regexp_extract(x, pattern, 1)))
    return F.coalesce(F.get(F.filter(values, lambda v: ~F.lower(v).isin(*NO_VALUE)), F.lit(0)), F.lit(""))


_HEADING = r"(?is)<h[23]\b[^>]*>.*?</h[23]>"


def _bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"[ \t\n\r\f]+", " "))


def thin_sections(html: Column, least: int = 260, most: int = 12) -> Column:
    """The first ``most`` headings of second and third level whose section has fewer than ``least`` characters of text."""
    h = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    heads, bodies = F.regexp_extract_all(h, F.lit(_HEADING), 0), F.split(h, _HEADING, -1)
    both = F.transform(heads, lambda x, i: F.struct(_bare(x).alias("heading"), F.length(_bare(F.get(bodies, i + 1))).alias("n")))
    return F.slice(F.filter(both, lambda s: (s["heading"] != "") & (s["n"] < least)), 1, most)


def _code(v: Column) -> Column:
    number = F.when(v.startswith("x"), F.conv(F.substring(v, 2, 16), 16, 10)).otherwise(v)
    return number.try_cast("long")


def _valid(n: Column) -> Column:
    return F.coalesce(n.isin(9, 10, 13) | n.between(0x20, 0xD7FF) | n.between(0xE000, 0xFFFD) | n.between(0x10000, 0x10FFFF), F.lit(False))


def bad_references(c: Column) -> Column:
    """How many character references name no XML character."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("&#(x[0-9A-Fa-f]+|[0-9]+);"), 1)
    return F.size(F.filter(found, lambda v: ~_valid(_code(v)))).cast("long")
