"""Integrity of cited sources and claims: rules over an index, its records, a link register and the evidence kept, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import quality, rules

#: Readiness that allows use, statuses of verified addresses, levels of use, classes of derived evidence, hosts whose bare address says nothing.
READY = ("claim_ready", "report_citable", "quote_verified")
VERIFIED, USABLE = ("ok", "verified", "200", "exact_url_verified"), ("report_citable", "quote_verified")
DERIVED = ("ai_working_summary", "analysis_note", "working_translation", "unknown_origin")
GENERIC_HOSTS = ("https://www.fsc.go.kr", "https://fsc.go.kr", "https://www.fss.or.kr", "https://fss.or.kr", "https://www.law.go.kr", "https://law.go.kr", "https://www.samsungpop.com", "https://samsungpop.com")
QUOTES = r"\n##\s+2\.\s*Exact Quotes"
CITED = "report_citable"
LEAST_RECORD = 1024


def _clean(c: str | Column) -> Column:
    """A cell without blanks and back-ticks around it; null empty."""
    return F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"(?U)^[\s`]+|[\s`]+$", "")


def linked(c: Column) -> Column:
    """The target of a markdown link, else the cell as it is; blanks and back-ticks around it go."""
    target = F.regexp_extract(c, r"\[[^\]]*\]\(([^)]*)\)", 1)
    return _clean(F.when(F.length(target) > 0, target).otherwise(c))


def generic_url(c: Column) -> Column:
    """An address of a listed host alone, or of any host without a path."""
    return F.regexp_replace(c, "/+$", "").isin(*GENERIC_HOSTS) | T.homepage_url(c)


def quote_section(text: Column) -> Column:
    """The section of exact quotes, up to the next numbered one."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?s){QUOTES}(.*?)(?:\n##\s+\d+\.|$)", 1)


def quotes(records: DataFrame) -> DataFrame:
    """(source_id, n, quote, weak): lines of a record's exact quotes without bullets, numbers and marks in front, in order."""
    lines = records.select("source_id", F.posexplode(F.split(quote_section(F.col("text")), "\n")).alias("n", "l"))
    q = lines.select("source_id", "n", T.strip(T.quote_line(F.col("l"))).alias("quote")).filter("quote <> ''")
    return q.withColumn("weak", T.weak_quote(F.col("quote")))


def source_findings(index: DataFrame, records: DataFrame, links: DataFrame, files: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source_id, severity, rule) of every source in the index, each rule once.

    ``index``: source_id, status, readiness, title, publisher, url_or_path, evidence_class, original_verified,
    reliability, used_in. ``records``: source_id, size, text and, beside the index's columns but the last two, capture_path,
    local_original_path, source_locator, exact_quote_location. ``links``: source_id, url, url_status, use_level,
    source_locator. ``files``: path, text of what is kept in the project. ``evidence``: source_id, text of the kept
    evidence. Ids are unique in each register; rows without one are no sources. Register joins are equi-joins on the
    id; a quote is looked for in its own source's evidence only.
    """
    i = index.withColumn("source_id", _clean("source_id")).filter("source_id <> ''").alias("i")
    r = records.withColumn("_record", F.lit(True)).alias("r")
    k = links.withColumn("_link", F.lit(True)).alias("k")
    first = lambda name: F.coalesce(F.nullif(F.col(f"r.{name}"), F.lit("")), F.col(f"i.{name}"), F.lit(""))
    own = lambda name: F.coalesce(F.nullif(F.col(f"i.{name}"), F.lit("")), F.col(f"r.{name}"), F.lit(""))
    cell = lambda name: F.coalesce(F.col(name), F.lit(""))
    j = i.join(r, "source_id", "left").join(k, "source_id", "left").select(
        "source_id", F.col("_record").isNotNull().alias("record"), F.col("_link").isNotNull().alias("link"), F.col("r.size").alias("size"), _clean(F.coalesce(F.nullif("i.status", F.lit("")), F.col("i.readiness"))).alias("index_status"),
        _clean(own("status")).alias("status"), F.lower(cell("k.url_status")).alias("url_status"), F.lower(cell("k.use_level")).alias("use_level"), F.trim(cell("k.url")).alias("link_url"), F.trim(cell("k.source_locator")).alias("locator"),
        linked(first("url_or_path")).alias("url"), _clean(first("evidence_class")).alias("evidence_class"), _clean(first("readiness")).alias("readiness"), F.lower(_clean(first("original_verified"))).alias("verified"), cell("i.reliability").alias("reliability"),
        own("title").alias("title"), cell("r.title").alias("record_title"), own("publisher").alias("publisher"), F.trim(cell("i.used_in")).alias("used_in"), linked(cell("r.capture_path")).alias("capture"), linked(cell("r.local_original_path")).alias("local_original"),
        (F.coalesce(F.nullif("k.source_locator", F.lit("")), F.nullif("r.source_locator", F.lit("")), F.nullif("r.exact_quote_location", F.lit(""))).isNotNull()).alias("located"),
    )
    # the files that addresses and originals name
    held = lambda name: files.select(F.col("path").alias(name), F.col("text").alias(f"{name}_text"), F.lit(True).alias(f"{name}_there"))
    j = j.join(held("url"), "url", "left").join(held("local_original"), "local_original", "left")
    # what the quotes and the evidence say
    q = quotes(records)
    proof = evidence.select("source_id", F.col("text").alias("_e"), quality.stub_heading(F.col("text")).alias("_stub"))
    kept = proof.groupBy("source_id").agg(F.bool_or("_stub").alias("stub"), F.bool_or(~F.col("_stub")).alias("genuine"), T.collapsed(F.array_join(F.array_sort(F.collect_list(F.when(~F.col("_stub"), F.col("_e")))), "\n")).alias("kept"))
    found = q.filter("not weak").join(proof.filter("not _stub"), "source_id").groupBy("source_id", "n").agg(F.bool_or(F.contains("_e", F.col("quote"))).alias("_in"))
    by = q.join(found, ["source_id", "n"], "left").groupBy("source_id").agg(F.bool_or("weak").alias("weak"), F.bool_or(~F.col("weak")).alias("strong"), F.bool_or(~F.col("weak") & ~F.coalesce("_in", F.lit(False))).alias("unproved"))
    j = j.join(kept.select("source_id", "stub", "genuine", ((F.length("kept") < 80) | T.portal_page(F.col("kept"))).alias("thin")), "source_id", "left").join(by, "source_id", "left")
    c = F.col
    cited, web = c("record") & (c("status") == CITED), c("url").rlike("^https?://")
    usable = c("use_level").isin(*USABLE)
    txt = lambda name: F.lower(c(name)).endswith(".txt") & c(f"{name}_there").isNotNull() & (quality.original_state(c(f"{name}_text")) != "original")
    unlike = quality.original_state(c("url_text")) != "original"
    here = c("record") & ~web & (c("url") != "") & c("url_there").isNotNull() & F.lower("url").endswith(".txt")
    yes = lambda name: F.coalesce(c(name), F.lit(False))
    checks = [
        ("error", "citable_without_record", ~c("record") & (c("index_status") == CITED)), ("warning", "without_record", ~c("record") & (c("index_status") != CITED)), ("error", "record_too_small", c("record") & (c("index_status") == CITED) & (c("size") < LEAST_RECORD)),
        ("error", "link_url_generic", c("record") & c("link") & (c("index_status") == CITED) & ((c("link_url") == "") | generic_url(c("link_url")))), ("error", "use_level_not_citable", c("record") & c("link") & (c("index_status") == CITED) & ~usable),
        ("error", "url_status_not_verified", c("record") & c("link") & (c("index_status") == CITED) & ~c("url_status").isin(*VERIFIED)), ("error", "locator_missing", c("record") & c("link") & (c("index_status") == CITED) & usable & (c("locator") == "")),
        ("error", "metadata_mismatch", cited & (quality.metadata_mismatch(F.coalesce(F.nullif("record_title", F.lit("")), c("title")), c("publisher"), c("url")) != "")), ("error", "url_or_path_missing", cited & (c("url") == "")),
        ("error", "link_row_missing", cited & web & ~c("link")), ("error", "capture_missing", cited & (c("evidence_class") == "captured_webpage") & (c("capture") == "") & (c("local_original") == "")), ("error", "local_original_not_original", cited & txt("local_original")),
        ("warning", "path_not_found", c("record") & (c("url") != "") & ~web & c("url_there").isNull()), ("error", "tier_1_not_original", here & unlike & F.contains("reliability", F.lit("Tier 1"))), ("warning", "original_unclear", here & unlike & ~F.contains("reliability", F.lit("Tier 1"))),
        ("error", "path_not_of_source", c("record") & ~web & (c("url") != "") & c("url_there").isNotNull() & ~quality.id_fits(c("source_id"), c("title"), c("url"))), ("error", "original_txt_not_original", cited & ~web & txt("url")),
        ("error", "homepage_cited", c("record") & web & generic_url(c("url")) & (c("readiness").isin(*READY) | (c("status") == CITED))), ("error", "derived_tier_1", c("record") & c("evidence_class").isin(*DERIVED) & F.contains("reliability", F.lit("Tier 1"))),
        ("error", "verified_homepage", c("record") & c("readiness").isin(*READY) & (c("verified") == "yes") & web & generic_url(c("url"))), ("warning", "used_before_ready", c("record") & (c("readiness") != "") & ~c("readiness").isin(*READY) & (c("used_in") != "")),
        ("warning", "used_unverified", c("record") & (c("verified") == "no") & (c("used_in") != "")), ("error", "quotes_weak", cited & yes("weak")), ("error", "evidence_stub", cited & yes("stub")), ("error", "evidence_thin", cited & yes("genuine") & c("thin")),
        ("error", "quotes_unproved", cited & yes("strong") & yes("genuine") & yes("unproved")), ("error", "quotes_without_evidence", cited & yes("strong") & ~yes("genuine") & ~yes("stub") & ~web), ("error", "quotes_without_locator", cited & yes("strong") & ~yes("genuine") & ~yes("stub") & web & ~c("located")),
    ]
    return rules.findings(j, "source_id", checks)


def claim_findings(claims: DataFrame, known: DataFrame) -> DataFrame:
    """(claim_id, severity, rule, key) of every claim; ``known`` are the ids of sources and records.

    Claims are (claim_id, claim_type, citation_type, status, source_ids, evidence_class, original_verified,
    report_use_allowed, exact_quote_location, evidence_paths, notes); source ids stand apart by commas or
    semicolons, and each that nobody knows is a finding with the id for its key.
    """
    low = lambda n: F.lower(F.coalesce(F.col(n), F.lit("")))
    q = claims.withColumn("claim_id", _clean("claim_id")).filter("claim_id <> '' and claim_id <> 'claim_id'")
    blank = lambda n: F.trim(F.coalesce(F.col(n), F.lit(""))) == ""
    status, kind, fact = low("status"), F.lower(_clean("citation_type")), F.contains(low("claim_type"), F.lit("fact"))
    verified, allowed = F.lower(_clean("original_verified")), F.lower(_clean("report_use_allowed"))
    checks = [
        ("warning", "citation_type_missing", status.isin(CITED, "cited") & (kind == "")), ("error", "quote_without_place", (kind == "direct_quote") & blank("exact_quote_location")), ("warning", "inference_without_notes", (kind == "inference") & blank("notes")),
        ("error", "fact_from_derived", fact & _clean("evidence_class").isin(*DERIVED)), ("error", "fact_unverified", fact & (verified == "no")), ("error", "fact_without_place", fact & blank("exact_quote_location")), ("error", "fact_without_evidence", fact & blank("evidence_paths")),
        ("warning", "legacy_status", fact & status.isin("cited", "source_backed")), ("error", "use_not_allowed", (allowed == "no") & status.isin("cited", CITED)),
    ]
    own = rules.findings(q, "claim_id", checks).withColumn("key", F.lit(""))
    named = q.select("claim_id", F.explode(F.split(F.coalesce("source_ids", F.lit("")), "[,;]")).alias("s")).select("claim_id", _clean("s").alias("key")).filter("key <> ''").distinct()
    lost = named.join(known.select(_clean(known.columns[0]).alias("key")).distinct(), "key", "left_anti")
    return own.unionByName(lost.select("claim_id", F.lit("warning").alias("severity"), F.lit("source_unknown").alias("rule"), "key"))
