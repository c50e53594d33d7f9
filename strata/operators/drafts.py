"""Drafts: scores of outlines, advice on chapters, assembly of parts, and allow-lists of what parts may hold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, points and terms below are fixed values.
#: What a plan by sections looks like, and the axes of which three are to be covered.
SECTIONS = r"(?mi)^#{1,4}\s+(?:제\s*\d+\s*장|chapter\s*\d+|ch\s*0*\d+|\d+(?:\.\d+)?[.)]\s+)|대목차|중목차|소목차|챕터별|장별|section[- ]by[- ]section"
AXES = (
    r"독자|reader|의사결정|decision|검토\s*질문|핵심\s*질문",
    r"증거|evidence|source|원문|공식\s*url|capture",
    r"리스크|risk|반론|counter|대안",
    r"데이터|data_sources|\.csv|\.xlsx|시나리오|scenario",
    r"표|그래프|차트|figure|chart|diagram|흐름도",
)
#: (part, points, pattern) beside the 15 points of a covered scope.
PARTS = (
    ("decision", 10, r"의사결정|decision|검토\s*질문|핵심\s*질문"),
    ("thesis", 10, r"핵심\s*논지|business thesis|가설|thesis"),
    ("evidence", 15, r"필요\s*자료|증거|source|원문|공식\s*url|capture"),
    ("claims", 10, r"claim|주장|미해결|unresolved|불확실|counsel"),
    ("data", 10, r"data_sources|\.csv|\.xlsx|시나리오|scenario|민감도"),
    ("visuals", 10, r"그래프|차트|figure|chart|diagram|흐름도"),
    ("risk", 10, r"반론|counter|risk|리스크|red\s*team|대안"),
    ("sequence", 5, r"챕터별|장별|순차|section[- ]by[- ]section"),
    ("design", 5, r"docx|pdf|템플릿|template|디자인"),
)
MARKUP = r"<table\b|<figure\b|<svg\b|<canvas\b|!\["
FIXED_COUNT = r"(?:목차|대목차|챕터|chapter|장\s*수).{0,32}(?:고정|제한|기본|default)"
DECISION = ("의사결정", "판단", "선택", "대안", "권고", "실행", "implication", "decision")
RISK = ("리스크", "위험", "한계", "반론", "잔존", "불확실", "counter", "risk", "limitation")
EVIDENCE = ("자료:", "근거", "출처", "각주", "참고문헌", "source", "evidence")
OVERCLAIMS = ("100% 보장", "완벽", "완전한 보호", "무조건", "절대", "압도적", "최고 수준")
STYLES = (
    "font-family", "font-size", "font-weight", "font-style", "color", "background-color", "text-decoration", "vertical-align",
    "margin", "line-height", "text-align", "break-before", "break-after", "padding", "width", "height", "border-spacing",
    "text-indent", "page-break-before", "page-break-after",
)


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern if pattern.startswith("(?") else f"(?i){pattern}")


def outline_score(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, earned, deducted, score, missing, blocked) of each outline; a null text is an empty one.

    The score is what the parts earn less the deductions, from 0 to 100. Below 70 the expansion to full text
    is blocked, below 80 the delivery too. missing lists at most the first eight parts without points.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    axes = sum((_has(t, a).cast("int") for a in AXES), F.lit(0))
    parts = [("scope", 15, _has(t, SECTIONS) & (axes >= 3)), *[(n, p, _has(t, x)) for n, p, x in PARTS]]
    earned = sum((F.when(ok, p).otherwise(0) for _, p, ok in parts), F.lit(0))
    no_summary = ~(F.contains(t, F.lit("0장")) | F.contains(F.lower(t), F.lit("chapter 0")))
    cuts = ((15, _has(t, MARKUP)), (10, F.length(t) < 3000), (10, _has(t, FIXED_COUNT)), (8, no_summary))
    deducted = sum((F.when(bad, p).otherwise(0) for p, bad in cuts), F.lit(0))
    missing = F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, _, ok in parts]))
    out = docs.select(key, earned.cast("long").alias("earned"), deducted.cast("long").alias("deducted"), F.array_join(F.slice(missing, 1, 8), ",").alias("missing"))
    out = out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("earned") - F.col("deducted"))).cast("long"))
    return out.withColumn("blocked", F.when(F.col("score") < 70, "expansion,delivery").when(F.col("score") < 80, "delivery").otherwise(""))


def _any(text: Column, terms: Iterable[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t.lower()))
    return found


def chapter_advice(chapters: DataFrame, key: str) -> DataFrame:
    """(key, status, advice, overclaims): what to mend in each chapter, in a fixed order.

    chapters: text (visible; null: no such chapter), summary, plan_exists, plan_coverage, plan_overlap, unlinked_claims,
    unlinked_visuals, thin (sections too short), tables and figures.
    """
    c, t = F.col, F.coalesce(F.col("text"), F.lit(""))
    low, body = F.lower(t), ~F.col("summary")
    over = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(x)), F.lit(x)) for x in OVERCLAIMS]))
    plan = F.when(~c("plan_exists"), "create_plan").when(c("plan_coverage") < 0.7, "complete_plan").when((c("plan_overlap") < 0.18) & body, "answer_plan")
    rules = (
        ("link_claims", c("unlinked_claims") > 0),
        ("link_visuals", c("unlinked_visuals") > 0),
        ("expand", F.length(t) < F.when(c("summary"), 900).otherwise(1200)),
        ("expand_sections", c("thin") > 0),
        ("name_decision", body & ~_any(low, DECISION)),
        ("name_risks", body & ~_any(low, RISK)),
        ("cite", ~_any(low, EVIDENCE)),
        ("caption_data", ~F.contains(t, F.lit("근거 데이터")) & (c("tables") + c("figures") > 0)),
        ("qualify", F.size(over) > 0),
    )
    advice = F.array_compact(F.array(plan, *[F.when(when, F.lit(n)) for n, when in rules]))
    status = F.when(c("text").isNull(), "missing").when(F.size(advice) > 0, "needs_attention").otherwise("strong_signal")
    return chapters.select(key, status.alias("status"), F.array_join(advice, ",").alias("advice"), F.array_join(over, "|").alias("overclaims"))


def assembled(parts: DataFrame, manifest: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """(key, n_parts, missing, body): the parts of each key, one after the other and unchanged.

    manifest (key, name, place) orders and chooses the parts of its keys; other keys take all parts by name.
    missing counts places of the manifest without a part; a null text is an empty part, and names are unique within a key.
    """
    named = manifest.select(key, F.col(name), F.col("place"))
    listed = named.join(parts.select(key, name, F.coalesce(text, F.lit("")).alias("_t")), [key, name], "left")
    free = parts.join(named.select(key).distinct(), key, "left_anti").select(key, name, F.lit(0).alias("place"), F.coalesce(text, F.lit("")).alias("_t"))
    both = listed.select(key, "place", name, "_t").unionByName(free.select(key, "place", name, "_t"))
    there = F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("place", name, "_t"))))
    out = both.groupBy(key).agg(F.count("_t").alias("n_parts"), F.count_if(F.col("_t").isNull()).alias("missing"), there.alias("_p"))
    return out.select(key, "n_parts", "missing", F.array_join(F.transform("_p", lambda p: p["_t"]), "").alias("body"))


def safe_style(style: Column, known: tuple[str, ...] = STYLES) -> Column:
    """The declarations of known properties without references to elsewhere; page breaks by their short names."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    pairs = F.transform(F.filter(F.split(style, ";"), lambda d: F.contains(d, F.lit(":"))), lambda d: F.struct(F.lower(strip(F.substring_index(d, ":", 1))).alias("n"), strip(F.regexp_replace(d, r"^[^:]*:", "")).alias("v")))
    good = F.filter(pairs, lambda p: p["n"].isin(*known) & (p["v"] != "") & ~p["v"].rlike(r"(?i)url\s*\(|@import"))
    return F.array_join(F.transform(good, lambda p: F.concat(F.regexp_replace(p["n"], r"^page-break-(before|after)$", "break-$1"), F.lit(":"), p["v"])), ";")


def safe_ref(value: Column, fallback: str = "report") -> Column:
    """At most 160 characters of letters, digits and ``_.:-``; a run of others becomes one hyphen."""
    cut = F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", ""), r"[^A-Za-z0-9_.:-]+", "-"), 1, 160)
    return F.when(cut == "", fallback).otherwise(cut)


def safe_enum(value: Column, fallback: str) -> Column:
    """The value in capitals if it is one word of letters, digits and ``_``, else the fallback."""
    up = F.upper(F.trim(F.when(value == "", None).otherwise(value)))
    return F.when(F.coalesce(up, F.lit(fallback)).rlike(r"^[\p{L}\p{N}_]+$"), F.coalesce(up, F.lit(fallback))).otherwise(fallback)


def safe_entry(name: Column) -> Column:
    """Whether a package entry stays inside: no drive, root, parent, backslash or NUL; null and empty names do not."""
    bad = F.contains(name, F.lit("\\")) | F.contains(name, F.lit("\0")) | F.startswith(name, F.lit("/")) | F.contains(name, F.lit(":")) | name.rlike(r"(^|/)\.\.(/|$)")
    return F.coalesce((name != "") & ~bad, F.lit(False))


def public_struct(value: Column, private: tuple[str, ...]) -> Column:
    """A struct without its private fields (payloads, digests), which may be given by dotted paths."""
    return value.dropFields(*private)
