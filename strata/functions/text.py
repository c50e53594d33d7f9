"""Scalar functions on texts, hashes and counts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"(?U)^\s+|\s+$"
#: Quotes that say nothing, and patterns of portal pages that a whole text must match.
GENERIC_QUOTES = ("국가법령정보센터", "법령", "홈페이지", "보도자료", "정책자료", "자료실", "메인")
PORTAL_PAGES = (r"\s*국가법령정보센터\s*\|\s*법령\s*국가법령정보센터\s*법령\s*", r"\s*국가법령정보센터\s*\|\s*법령\s*", r"\s*홈\s*>\s*")


def strip(c: Column) -> Column:
    """Removes Unicode white space at both ends, not only blanks."""
    return F.regexp_replace(c, _BLANK, "")


def fold_key(c: Column) -> Column:
    """Comparison key: lower case, without white space, underscores and hyphens."""
    return F.regexp_replace(F.lower(strip(c)), r"[\s_\-]+", "")


def token_estimate(c: Column) -> Column:
    """A quarter of the length, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def clean_cell(c: Column) -> Column:
    """A table cell without white space, then back-ticks, then stars at its ends; what is inside stays."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^`+|`+$", ""), r"^\*+|\*+$", ""))


def slug(c: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9a-z]+", "-"), "^-+|-+$", ""), 1, most)


def short_ref(c: Column, n: int = 24) -> Column:
    return F.left(F.sha2(c, 256), F.lit(n))


def count_bucket(n: Column) -> Column:
    return F.when(n <= 0, "none").when(n < 100, "small").when(n < 1000, "medium").when(n < 10000, "large").otherwise("very_large")


def size_bucket(b: Column) -> Column:
    kib = 1024
    return (F.when(b < 16 * kib, "under_16k").when(b < 128 * kib, "under_128k").when(b < kib * kib, "under_1m")
            .when(b < 10 * kib * kib, "under_10m").otherwise("over_10m"))


def collapsed(c: Column) -> Column:
    """White space collapsed to single blanks, none at the ends; a null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def portal_page(c: Column) -> Column:
    """Whether a collapsed text is nothing but a portal's frame."""
    return c.rlike("(?i)^(" + "|".join(PORTAL_PAGES) + ")$")


def weak_quote(c: Column, least: int = 18, distinct: int = 6) -> Column:
    """Too short, of too few different characters, a generic fragment or a portal's frame; outer quote marks do not count."""
    text = F.regexp_replace(F.regexp_replace(collapsed(c), '^"+|"+$', ""), "^'+|'+$", "")
    return (F.length(text) < least) | (F.size(F.array_distinct(F.split(text, ""))) <= distinct) | text.isin(*GENERIC_QUOTES) | portal_page(text)


def homepage_url(c: Column) -> Column:
    """A URL without a path beyond its host."""
    return F.coalesce(c, F.lit("")).rlike(r"^https?://[^/]+/?(#.*)?$")


def relation(a: Column, b: Column) -> Column:
    """How two counts agree: exact, close (within 5 percent, at least 2), both_present, one-sided, mismatch; missing_signal without either."""
    near = F.greatest(F.lit(2), F.bround(F.greatest(F.abs(a), F.abs(b)) * 0.05).cast("long"))
    both = F.when(F.abs(a - b) <= near, "close").otherwise("both_present")
    return (F.when(a.isNull() | b.isNull(), "missing_signal").when(a == b, "exact").when((a > 0) & (b > 0), both)
            .when((a == 0) & (b > 0), "target_only").when((a > 0) & (b == 0), "source_only").otherwise("mismatch"))


def metric_similarity(a: Column, b: Column) -> Column:
    """1 for equal numbers, falling to 0 with their difference relative to the larger one."""
    top = F.greatest(F.lit(1.0), a.cast("double"), b.cast("double"))
    return F.bround(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / top), 4)


def size_of_overlap(a: Column, b: Column) -> Column:
    """Characters two texts share, each as often as it is in both."""
    count = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    times = lambda xs, c: F.size(F.filter(xs, lambda x: x == c))
    x, y = count(a), count(b)
    return F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, c: s + F.least(times(x, c), times(y, c)))


def to_int(c: Column, default: int = 0) -> Column:
    """The number a text holds, or the default."""
    return F.coalesce(c.try_cast("int"), F.lit(default))


def truthy(c: Column, words: tuple[str, ...] = ("1", "true", "yes", "y")) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).isin(*words)


def tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct tokens without stop words: Latin ones of four characters or more that begin with a letter, Hangul ones of two."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"[a-z][a-z0-9_-]{3,}|[가-힣]{2,}"), 0))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop])) if stop else found


def quote_line(c: Column) -> Column:
    """A line without bullets, numbers and quote marks in front, a leading year among them."""
    return F.regexp_replace(c, r"^[-*>0-9. \t]+", "")


def stamp(c: Column, hours: int = 9) -> Column:
    """A UTC time as text at a fixed offset."""
    return F.concat(F.date_format(c + F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"+{hours:02d}:00"))


def from_mm(c: Column) -> Column:
    """Millimetres in units of which 7200 make an inch."""
    return c * 7200 / F.lit(25.4)


def colour(c: Column) -> Column:
    """An integer as #rrggbb."""
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(c)), 6, "0"))


def without_controls(c: Column) -> Column:
    """Text without control and unassigned characters, line ends and tabs kept."""
    return F.regexp_replace(c, r"[\p{C}&&[^\n\t\r]]", "")


def shingles(c: Column, n: int) -> Column:
    """Runs of n words as an array, in order; empty below n words. The words are bound once, not split anew for each run."""
    words = F.filter(F.split(c, r"[ \t\n\r\f]+"), lambda w: w != "")
    runs = lambda ws: F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(words), runs)[0]


#: What a field says that has no value.
NO_VALUE = ("", "n/a", "na", "none", "null", "undecided", "미정")


def clean_field(c: Column) -> Column:
    """A field's value without back-ticks around it and without what follows a blank and #, (, // or |; empty where it says that there is none."""
    bare = strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^`+|`+$", ""))
    value = strip(F.regexp_replace(bare, r"(?Us)\s+(?:#|\(|//|\|).*$", ""))
    return F.when(F.lower(value).isin(*NO_VALUE), "").otherwise(value)


def link_target(c: Column) -> Column:
    """The target of the first markdown link, else the cell without blanks and back-ticks around it."""
    target = F.regexp_extract(F.coalesce(c, F.lit("")), r"\]\(([^)]+)\)", 1)
    return F.when(F.length(target) > 0, target).otherwise(F.regexp_replace(F.coalesce(c, F.lit("")), "^[` ]+|[` ]+$", ""))
