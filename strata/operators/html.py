"""Structure counts and plain text of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = ("a", "p", "li", "script", "style", "table", "figure", "img", "svg", "h1", "h2", "h3")


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(F.coalesce(html, F.lit("")), F.lit(rf"(?i)<{tag}[\s>]"))


def metrics(pages: DataFrame) -> DataFrame:
    """Characters, opening tags by name, and whether the page has a title."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.length(html).cast("long").alias("chars"), *[tag_count(F.col("html"), t).cast("long").alias(f"n_{t}") for t in TAGS], html.rlike("(?i)<title>[^<]+</title>").alias("has_title"))


def stripped(html: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed; entities stay as they are."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\n\r\f]+", " "))


#: What makes a figure or a container a visual one.
MEDIA = r"(?i)<(?:svg|img|canvas)\b"
VISUAL_CLASS = r"""(?i)class=["'][^"']*(?:chart|graph|diagram|timeline|flow)[^"']*["']"""
_FIGURE = r"(?is)<figure\b[^>]*>.*?</figure>"
_CONTAINER = r"""(?i)<(?:div|section|article)\b[^>]*class=["'][^"']*(?:chart|graph|diagram|timeline|flow)[^"']*["']"""
_COVER = r"""(?is)<section\b[^>]*class=["'][^"']*cover-page[^"']*["'][^>]*>.*?</section>"""
_SUMMARY = r"(?i)(?:제\s*0\s*장|0\s*[.)]\s*|chapter\s*0)[^\n<]{0,80}(?:요약|executive\s*summary)|(?:요약|executive\s*summary)[^\n<]{0,40}(?:제\s*0\s*장|chapter\s*0)"


def material_figures(html: Column) -> Column:
    """Figures with media or a visual class, and media and visual containers outside of figures.

    A figure ends at the first end tag after its begin, so that a figure within a figure is part of it, and one
    that is not closed is none: what stands in it counts as outside.
    """
    html = F.coalesce(html, F.lit(""))
    blocks = F.filter(F.regexp_extract_all(html, F.lit(_FIGURE), 0), lambda b: b.rlike(MEDIA) | b.rlike(VISUAL_CLASS))
    rest = F.regexp_replace(html, _FIGURE, "")
    return F.size(blocks) + F.regexp_count(rest, F.lit(MEDIA)) + F.regexp_count(rest, F.lit(_CONTAINER))


def report_metrics(html: Column, template: tuple[str, ...] = (), cover: tuple[str, ...] = ()) -> Column:
    """What a report's page shows: visible characters, tables and figures outside of comments, styles and the cover, captions, notes and flags.

    ``template`` and ``cover`` are marks that the raw page holds if it was made from the template or with a cover.
    """
    raw = F.coalesce(html, F.lit(""))
    shown = F.regexp_replace(raw, r"(?s)<!--.*?-->", "")
    material = F.regexp_replace(F.regexp_replace(shown, r"(?is)<style\b[^>]*>.*?</style>", ""), _COVER, "")
    visible = stripped(shown)
    any_of = lambda marks: F.greatest(*[F.contains(raw, F.lit(m)) for m in marks], F.lit(False), F.lit(False))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return F.struct(
        F.length(visible).cast("long").alias("visible_chars"), count(material, r"(?i)<table\b").alias("tables"), material_figures(material).cast("long").alias("figures"), count(visible, "자료:").alias("source_captions"),
        count(visible, "근거 데이터").alias("data_captions"), visible.rlike(r"(?i)\bAppendix\b|부록").alias("appendix"), count(raw, r"(?i)<sup\b|footnote|주석|참고문헌").alias("footnotes"), any_of(template).alias("uses_template"),
        (F.contains(raw, F.lit('data-assembled-report="true"')) | F.contains(raw, F.lit("mode: concatenate_only_no_rewrite"))).alias("assembled"), any_of(cover).alias("uses_cover"), visible.rlike(_SUMMARY).alias("summary"),
    )
