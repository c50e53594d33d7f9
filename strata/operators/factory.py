"""Completeness of report projects: findings from their files and visual plans, each with a rule and a severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a visual plan must have, preset names that mean none, flags of a required visual.
PLAN_COLUMNS = ("chapter", "decision_use", "purpose", "status", "visual_id", "visual_type")
NO_PRESET = ("", "undecided", "none", "n/a", "na", "null", "-")
REQUIRED, PLANNED = ("yes", "y", "true", "1", "required"), ("required", "planned")
MODE = "concatenate_only_no_rewrite"
CHAPTERS, WORKPACKS = "reports/chapters", "reports/chapter_workpacks"
MANIFEST, COVER, POINTER, PLAN = "reports/report_assembly_manifest.json", "reports/cover.data.json", "reports/current/version_pointer.json", "data_sources/visual_plan.csv"
VISUAL_PASS, VISUAL_NOTE = "reports/visual_pass_manifest.json", "reports/visual_review.md"
_EXTERNAL = r"""(?i)<script\b[^>]*\bsrc=["']https?://"""
_WRAPPER = r"(?i)</?(?:html|head|body)\b"
_HASHES = "array<struct<path:string,sha256:string>>"


#: Sections that a chapter's workpack must have, what an unfilled one shows, and how long it is at least.
SECTIONS = ("Reader Decision", "Reader Takeaway", "Core Question", "Required Answer Boundary", "Paragraph Plan", "Evidence Inputs", "Claim Register Links", "Counterarguments", "Required Visuals", "Forbidden Claims", "Completion Checklist")
UNFILLED = (r"-\s*chapter_id:\s*$", r"\|\s*\|\s*\|\s*\|", r"\|\s*1\s*\|\s*\|\s*\|\s*\|")
LEAST_WORKPACK = 900


def workpack_issues(text: Column) -> Column:
    """What a workpack lacks, as texts: length, sections (the first six), filled-in placeholders."""
    t = F.coalesce(text, F.lit(""))
    lacks = F.filter(F.array(*[F.when(~F.contains(F.lower(t), F.lit(m.lower())), m) for m in SECTIONS]), lambda m: m.isNotNull())
    short = F.length(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")) < LEAST_WORKPACK
    empty = t.rlike("(?im)" + "|".join(UNFILLED))
    missing = F.concat(F.lit("missing required workpack sections: "), F.array_join(F.slice(lacks, 1, 6), ", "))
    return F.array_compact(F.array(F.when(short, "too short to guide rich chapter writing"), F.when(F.size(lacks) > 0, missing), F.when(empty, "contains unfilled template placeholders")))


def _in(folder: str, names: str) -> Column:
    return F.col("path").rlike(rf"^{folder}/{names}$")


def _assembled() -> Column:
    marks = F.contains("text", F.lit('data-assembled-report="true"')) | F.contains("text", F.lit(f"mode: {MODE}"))
    return _in("reports", r"[^/]*\.html") & F.coalesce(marks, F.lit(False))


def facts(files: DataFrame, markers: list[str]) -> DataFrame:
    """What each project has, from its files (project, path, text): one aggregate, texts stay where they are.

    A project is substantial if its requirements or drafts name one of the markers, in any case. Fields of the
    JSON files are read where the file is; what is no JSON has none.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    plans = _in("report_prd", r"[^/]*\.md") | _in("drafts", r"[^/]*\.md")
    named = F.greatest(*[F.contains(text, F.lit(m.lower())) for m in markers], F.lit(False), F.lit(False))
    has = {
        "substantial": plans & named, "prd": _in("report_prd", r"[^/]*\.md"), "toc": _in("drafts", r"[^/]*(?:toc|목차)[^/]*\.md"), "skeleton": _in("(?:drafts|reports)", r"[^/]*(?:skeleton|골조)[^/]*\.md"),
        "workpacks": _in(WORKPACKS, r"ch[^/]*_workpack\.md"), "chapters": _in(CHAPTERS, r"ch[^/]*\.html"), "cover": F.col("path") == COVER, "assembled": _assembled(), "manifest": F.col("path") == MANIFEST, "plan": F.col("path") == PLAN,
        "data": _in("data_sources", r"[^/]*\.(?i:csv|xlsx|xls|tsv)") & (F.lower("path") != PLAN), "note": F.col("path") == VISUAL_NOTE, "visual_pass": F.col("path") == VISUAL_PASS,
    }
    field = lambda path, name: F.trim(F.coalesce(F.max(F.when(F.col("path") == path, F.get_json_object("text", f"$.{name}"))), F.lit("")))
    fields = {"pointer": field(POINTER, "version"), "pointer_key": field(POINTER, "version_key"), "cover_version": field(COVER, "version"), "mode": field(MANIFEST, "assembly_mode")}
    listed = F.max(F.when(F.col("path") == MANIFEST, F.get_json_object("text", "$.visual_pass_manifest"))).alias("listed_pass")
    hashes = F.coalesce(F.max(F.when(F.col("path") == MANIFEST, F.size(F.from_json(F.get_json_object("text", "$.chapter_integrity"), _HASHES)))), F.lit(0)).alias("hashes")
    return files.groupBy("project").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in has.items()], *[c.alias(n) for n, c in fields.items()], listed, hashes)


def _recorded(files: DataFrame, path: str, field: str) -> DataFrame:
    """(project, path, sha): hashes that a manifest of each project records for chapters; of a path repeated the greatest."""
    one = files.filter(F.col("path") == path).select("project", F.explode(F.from_json(F.get_json_object("text", f"$.{field}"), _HASHES)).alias("h"))
    return one.groupBy("project", F.col("h.path").alias("path")).agg(F.max("h.sha256").alias("sha"))


def findings(files: DataFrame, visuals: DataFrame, markers: list[str], presets: list[str], legacy: list[str], strict: bool = True, modern: bool = False) -> DataFrame:
    """(project, severity, rule, key): every finding of every project.

    ``visuals`` are rows of visual plans (project, place, columns, visual_id, title, purpose, decision_use,
    expected_reader_takeaway, required, status, data_file, source_record), columns the names in the plan's
    header. Gaps are errors; those of legacy projects under strict rules are warnings unless modern rules are enforced.
    ``key`` is the file, visual or value that a finding is about, of lists the first eight.
    """
    f = facts(files, markers)
    c = F.col
    finding = lambda rule, when, gap=True, key=F.lit(""): F.when(when, F.struct(F.lit(gap).alias("gap"), F.lit(rule).alias("rule"), key.alias("key")))
    s = F.lit(strict)
    stale = (c("pointer") != "") & (c("cover_version") != "") & ~c("cover_version").isin(c("pointer"), c("pointer_key"))
    pointed = F.concat_ws("/", "cover_version", "pointer", "pointer_key")
    by_project = [
        finding("prd_missing", c("substantial") & ~c("prd")), finding("toc_missing", c("substantial") & ~c("toc")), finding("skeleton_missing", c("substantial") & ~c("skeleton"), strict), finding("workpacks_missing", c("chapters") & ~c("workpacks")),
        finding("chapters_missing", s & c("substantial") & ~c("chapters")), finding("cover_missing", s & c("substantial") & ~c("cover")), finding("cover_stale", s & c("assembled") & stale, key=pointed), finding("assembled_without_chapters", c("assembled") & ~c("chapters")),
        finding("manifest_missing", s & c("assembled") & ~c("manifest")), finding("manifest_mode", s & c("assembled") & c("manifest") & (c("mode") != MODE)), finding("integrity_missing", s & c("assembled") & (c("hashes") <= 0)),
        finding("plan_missing", c("substantial") & ~c("plan")), finding("columns_missing", c("plan") & ~c("rows"), key=F.lit(", ".join(PLAN_COLUMNS))), finding("data_missing", s & c("plan") & c("rows") & ~c("data")), finding("review_missing", s & c("chapters") & c("plan") & c("rows") & c("data") & ~c("visual_pass") & ~c("note"), False),
    ]
    ready = s & c("chapters") & c("plan") & c("rows") & c("data")
    by_project += [
        finding("pass_unexpected", ready & c("visual_pass") & c("assembled") & ~F.coalesce(c("listed_pass").isin("", VISUAL_PASS), F.lit(False))),
        finding("pass_not_listed", ready & c("visual_pass") & c("assembled") & (c("listed_pass") == ""), False), finding("pass_not_there", ready & ~c("visual_pass") & c("assembled") & (F.coalesce("listed_pass", F.lit("")) != "")),
    ]
    planned = visuals.groupBy("project").agg(F.count("*").alias("_rows"))
    f = f.join(planned, "project", "left").withColumn("rows", F.coalesce(F.col("_rows") > 0, F.lit(False))).drop("_rows")
    each = lambda df, items: df.select("project", F.explode(F.array_compact(F.array(*items))).alias("f")).select("project", "f.*")
    out = [each(f, by_project)]
    chapters = files.filter(_in(CHAPTERS, r"ch[^/]*\.html")).select("project", "path", "text")
    stem = F.regexp_extract("path", r"([^/]+)\.html$", 1)
    out.append(each(chapters, [finding("chapter_wrapped", F.col("text").rlike(_WRAPPER), key=c("path"))]))
    wanted = chapters.select("project", "path", F.concat(F.lit(f"{WORKPACKS}/"), stem, F.lit("_workpack.md")).alias("_w"))
    packs = files.select("project", F.col("path").alias("_w"))
    if strict:
        thin = files.filter(_in(WORKPACKS, r"ch[^/]*_workpack\.md")).select("project", "path", F.explode(workpack_issues(c("text"))).alias("_i"))
        out.append(thin.select("project", F.lit(True).alias("gap"), F.lit("workpack_thin").alias("rule"), F.concat("path", F.lit(" ("), "_i", F.lit(")")).alias("key")))
    out.append(each(wanted.join(packs, ["project", "_w"], "left_anti"), [finding("chapter_without_workpack", F.lit(True), key=c("path"))]))
    # presets that the requirements name
    named = F.regexp_extract_all("text", F.lit(r"(?im)^\s*(?:[-*]\s*)?`?document_type_preset`?\s*[:：]\s*`?([A-Za-z0-9_.-]+)`?"), 1)
    values = files.filter(_in("report_prd", r"[^/]*\.md")).select("project", F.explode(named).alias("v")).filter(~F.lower(F.trim("v")).isin(*NO_PRESET) & ~c("v").isin(*presets)).distinct()
    if presets:
        out.append(values.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("v")), ", ").alias("k")).select("project", F.lit(True).alias("gap"), F.lit("preset_unsupported").alias("rule"), c("k").alias("key")))
    if strict:
        html = files.filter(_assembled() | _in(CHAPTERS, r"ch[^/]*\.html")).select("project", "path", _assembled().alias("_a"), c("text").rlike(_EXTERNAL).alias("_x"))
        first = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(c("_x"), F.struct((~c("_a")).alias("late"), "path")))), lambda x: x["path"]), 1, 8), ", ")
        cdn = html.groupBy("project").agg(F.bool_or("_a").alias("_has"), first.alias("key")).filter(c("_has") & (c("key") != ""))
        out.append(cdn.select("project", F.lit(True).alias("gap"), F.lit("external_scripts").alias("rule"), "key"))
        # chapters against the hashes that manifests record, and against the last assembled report
        recorded = f.filter("assembled and hashes > 0").select("project")
        now = chapters.join(recorded, "project", "left_semi").select("project", "path", F.sha2(c("text").cast("binary"), 256).alias("_sha"))
        met = now.join(_recorded(files, MANIFEST, "chapter_integrity"), ["project", "path"], "left")
        out.append(each(met, [finding("chapter_changed", ~F.coalesce(c("_sha") == c("sha"), F.lit(False)), key=c("path"))]))
        last = files.filter(_assembled()).groupBy("project").agg(F.max_by("text", "path").alias("_report")).join(recorded, "project", "left_semi")
        out.append(each(chapters.join(last, "project"), [finding("chapter_not_contained", ~F.contains("_report", c("text")), key=c("path"))]))
        passed = f.filter("visual_pass and chapters and plan and rows and data").select("project")
        body = chapters.filter(~stem.startswith("ch00")).join(passed, "project", "left_semi").select("project", "path", F.sha2(c("text").cast("binary"), 256).alias("_sha"))
        out.append(each(body.join(_recorded(files, VISUAL_PASS, "body_chapter_integrity"), ["project", "path"], "left"), [finding("pass_stale", ~F.coalesce(c("_sha") == c("sha"), F.lit(False)), key=c("path"))]))
    out += _visual_findings(files, visuals.join(f.filter("plan").select("project"), "project", "left_semi"), strict)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    softened = c("project").cast("string").isin(*legacy) if legacy and strict and not modern else F.lit(False)
    return found.select("project", F.when(c("gap") & ~softened, "error").otherwise("warning").alias("severity"), F.when(c("gap") & softened, F.concat(F.lit("legacy:"), "rule")).otherwise(c("rule")).alias("rule"), "key")


def _visual_findings(files: DataFrame, visuals: DataFrame, strict: bool) -> list[DataFrame]:
    c = F.col
    blank = lambda n: F.coalesce(c(n), F.lit("")) == ""
    name = F.coalesce(F.nullif("visual_id", F.lit("")), F.concat(F.lit("row_"), c("place").cast("string")))

    def first(when: Column) -> Column:
        return F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("place", name.alias("n"))))), lambda x: x["n"]), 1, 8), " | ")

    lacks = F.array_join(F.array_except(F.array(*map(F.lit, PLAN_COLUMNS)), F.max("columns")), ", ")
    by = visuals.groupBy("project").agg(lacks.alias("columns_missing"), first(blank("purpose") | blank("decision_use")).alias("roles_weak"), first(blank("expected_reader_takeaway")).alias("takeaway_weak"))
    gap = {"columns_missing": True, "roles_weak": strict, "takeaway_weak": False}
    lists = F.array(*[F.struct(F.lit(g).alias("gap"), F.lit(n).alias("rule"), c(n).alias("key")) for n, g in gap.items()])
    out = [by.select("project", F.explode(F.filter(lists, lambda x: x["key"] != "")).alias("f")).select("project", "f.*")]
    need = F.lower(F.coalesce("required", F.lit(""))).isin(*REQUIRED) | F.lower(F.coalesce("status", F.lit(""))).isin(*PLANNED)
    shown = F.coalesce(F.nullif("visual_id", F.lit("")), F.nullif("title", F.lit("")), F.lit("(unnamed visual)"))
    v = visuals.filter(need).select("project", shown.alias("key"), F.coalesce("data_file", F.lit("")).alias("path"), blank("source_record").alias("_bare"))
    out.append(v.filter((c("path") == "") & c("_bare")).select("project", F.lit(strict).alias("gap"), F.lit("visual_without_data").alias("rule"), "key"))
    away = v.filter((c("path") != "") & ~c("path").rlike("^https?://")).join(files.select("project", "path"), ["project", "path"], "left_anti")
    out.append(away.select("project", F.lit(strict).alias("gap"), F.lit("visual_data_missing").alias("rule"), F.concat_ws(": ", "key", "path").alias("key")))
    return out
