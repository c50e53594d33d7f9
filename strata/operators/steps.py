"""Steps of a report: what to do next, which files a stage reads, which visuals to plan or still lack, settings, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators import rules

# Names, paths, terms and conditions below are fixed values.
#: (state, action, what must hold to leave it), in order.
STEPS = (
    ("scope_not_defined", "create_report_prd", "prd > 0"),
    ("prd_exists_toc_missing", "create_detailed_toc", "toc > 0"),
    ("toc_exists_user_approval_needed", "review_detailed_toc", "toc_reviews > 0"),
    ("toc_exists_source_plan_missing", "create_source_collection_plan", "source_plans > 0"),
    ("evidence_mapping_needed", "map_sources_and_claims", "sources > 0 AND claims > 0 AND registers_agree"),
    ("source_claim_mapping_ready_skeleton_missing", "create_major_skeleton", "skeletons > 0"),
    ("skeleton_exists_workpacks_missing", "create_chapter_workpacks", "workpacks > 0"),
    ("drafting_preflight_needed", "map_sources_and_claims", "preflight"),
    ("workpacks_exist_chapter_fragments_missing", "draft_chapter_fragments", "chapters > 0"),
    ("chapter_fragments_exist_quality_review_required", "run_chapter_quality_review", "reviewed"),
    ("chapter_quality_review_done_enhancement_required", "enhance_chapter_fragments", "enhanced"),
    ("chapter_fragments_exist_visuals_incomplete", "create_visual_plan_and_data", "visual_rows > 0 AND data_files > 0 AND visual_pass"),
    ("body_and_visuals_stable_chapter0_missing", "write_chapter0_summary", "chapter0 AND summaries > 0"),
    ("chapter0_exists_style_pass_required", "run_pre_assembly_style_pass", "style_pass"),
    ("content_exists_cover_data_missing", "prepare_cover_data", "cover"),
    ("components_ready_assembly_missing", "assemble_report", "report AND manifest"),
    ("style_pass_complete_reassembly_required", "assemble_report", "assembled_after_style"),
    ("strict_factory_gaps_block_review", "repair_factory_gaps", "factory_errors = 0"),
)
READY = ("ready_for_review_gates", "run_review_candidate_gates")
#: (stage, path, required); {chapter} stands for the chapter of the request.
STAGE_FILES = (
    ("interview", "questions/question_log.md", False),
    ("interview", "assumptions/assumption_register.md", False),
    ("interview", "project_state/report_stage_manifest.json", False),
    ("design", "reports/report_design.md", False),
    ("source", "drafts/source_collection_plan.md", False),
    ("source", "references/reference_inventory.csv", False),
    ("source", "project_state/context_index_manifest.json", False),
    ("source", "source_index/source_master_index.md", False),
    ("chapter", "reports/chapter_workpacks/{chapter}_workpack.md", True),
    ("chapter", "reports/report_claim_register.md", False),
    ("chapter", "source_index/source_master_index.md", False),
    ("chapter", "project_state/context_index_manifest.json", False),
    ("chapter", "data_sources/visual_plan.csv", False),
    ("chapter", "reports/chapters/{chapter}.html", False),
    ("visual", "data_sources/visual_plan.csv", True),
    ("visual", "reports/report_claim_register.md", False),
    ("assemble", "reports/cover.data.json", True),
    ("assemble", "reports/report_assembly_manifest.json", False),
    ("review", "reports/internal_review_report.html", False),
    ("review", "data_sources/visual_plan.csv", False),
    ("review", "reports/report_claim_register.md", False),
)
#: Terms by kind of visual; of equal hits the kind that comes first is taken.
VISUALS = {
    "flow_diagram": ("flow", "process", "settlement", "architecture", "역할", "흐름", "정산", "구조", "프로세스"),
    "decision_matrix": ("option", "alternative", "compare", "tradeoff", "대안", "비교", "선택", "장단점"),
    "timeline": ("timeline", "roadmap", "milestone", "schedule", "일정", "단계", "입법", "로드맵"),
    "scenario_chart": ("scenario", "sensitivity", "projection", "revenue", "cost", "시장", "수익", "비용", "시나리오"),
    "risk_heatmap": ("risk", "legal", "compliance", "approval", "리스크", "규제", "법률", "승인", "불확실"),
}
NO_VISUAL = "evidence_table"
TITLES = (r"(?i)Reader Decision\s*\n+([^\n]+)", r"(?i)Core Question\s*\n+([^\n]+)", r"#\s+([^\n]+)")
REQUIRED = ("yes", "y", "true", "1", "required")
DROPPED = ("dropped", "cancelled", "not_applicable")
CHART_LIKE = r"(?i)(chart|graph|diagram|flow|map|timeline|heatmap|matrix|도식|차트|그래프|흐름|로드맵|히트맵)"
YES, NO = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")
#: (severity, rule, condition) on one exported file.
EXPORT_RULES = (
    ("warning", "locked", "kind = 'docx' AND locked"),
    ("error", "docx_structure", "kind = 'docx' AND NOT locked AND NOT (valid AND has_document)"),
    ("error", "docx_styles", "kind = 'docx' AND NOT locked AND strict AND NOT has_styles"),
    ("error", "pdf_header", "kind = 'pdf' AND NOT valid"),
    ("error", "hwpx_structure", "kind = 'hwpx' AND NOT (valid AND mimetype)"),
    ("error", "hwpx_contract", "kind = 'hwpx' AND strict AND NOT contract"),
    ("warning", "no_evidence", "checks = 0"),
    ("error", "strict_evidence", "checks = 0 AND strict"),
    ("warning", "no_render", "checks > 0 AND renders = 0"),
)


def next_step(facts: DataFrame, key: str, steps=STEPS, ready: tuple[str, str] = READY) -> DataFrame:
    """(key, state, action, done): the first step whose condition does not hold (null: does not), and how many before it do."""
    first = rules.first_failure(facts, key, [(state, F.expr(ok)) for state, _, ok in steps])
    actions = F.array(*[F.lit(a) for _, a, _ in steps], F.lit(ready[1]))
    return first.select(key, F.coalesce("failed", F.lit(ready[0])).alias("state"), F.element_at(actions, F.col("passed") + 1).alias("action"), F.col("passed").cast("long").alias("done"))


def stage_files(requests: DataFrame, files: DataFrame, key: str, declared=STAGE_FILES) -> DataFrame:
    """(key, path, required, present) of the files a request's stage reads; a path named twice is one, required if either is.

    requests: key, stage, chapter (null or empty: ch01). files: key, path; repeated ones count once. The
    declared table is a few rows of the program and goes along as a literal.
    """
    named = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(p).alias("path"), F.lit(r).alias("required")) for s, p, r in declared])
    chapter = F.coalesce(F.nullif(F.col("chapter"), F.lit("")), F.lit("ch01"))
    rows = requests.select(key, chapter.alias("_c"), F.explode(F.filter(named, lambda x: x["stage"] == F.col("stage"))).alias("_f"))
    rows = rows.groupBy(key, F.replace(F.col("_f.path"), F.lit("{chapter}"), F.col("_c")).alias("path")).agg(F.bool_or("_f.required").alias("required"))
    there = files.select(key, "path").distinct().withColumn("_there", F.lit(True))
    return rows.join(there, [key, "path"], "left").select(key, "path", "required", F.coalesce("_there", F.lit(False)).alias("present"))


def suggested_visuals(chapters: DataFrame, planned: DataFrame, group: str, kinds: dict[str, tuple[str, ...]] = VISUALS, none: str = NO_VISUAL) -> DataFrame:
    """(group, visual_id, kind, title): a visual for each chapter whose id is not planned yet in its group, in any case.

    chapters: group, chapter, place (its number), text (null: empty). planned: group, visual_id.
    """
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    hits = {k: sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0)) for k, terms in kinds.items()}
    c = chapters.select(group, "chapter", "place", text.alias("_t"), *[n.alias(k) for k, n in hits.items()])
    most = F.greatest(*kinds)
    kind = F.lit(None).cast("string")
    for k in reversed(kinds):
        kind = F.when(F.col(k) == most, k).otherwise(kind)
    kind = F.when(most == 0, none).otherwise(kind)
    found = [F.nullif(F.trim(F.regexp_replace(F.regexp_extract("_t", p, 1), r"\s+", " ")), F.lit("")) for p in TITLES]
    plain = F.concat("chapter", F.lit(" "), F.replace(kind, F.lit("_"), F.lit(" ")))
    own = F.concat(F.lit("vis-"), "chapter", F.lit("-"), F.lpad(F.col("place").cast("string"), F.greatest(F.lit(2), F.length(F.col("place").cast("string"))), F.lit("0")))
    out = c.select(group, own.alias("visual_id"), kind.alias("kind"), F.coalesce(*[F.substring(f, 1, 80) for f in found], plain).alias("title"))
    have = planned.select(group, F.lower(F.trim("visual_id")).alias("_id")).filter("_id <> ''").distinct()
    return out.withColumn("_id", F.lower("visual_id")).join(have, [group, "_id"], "left_anti").drop("_id")


def missing_visuals(reports: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """(key, n_required, n_missing, missing, chart_missing) of each report that has a plan.

    reports: key, visible, raw, figures. plan: key, visual_id, title, data_file, required, status, kind. A
    required visual that was not dropped is there if its title is visible or its data file is named. missing
    has the eight smallest names; chart_missing: one is chart-like and the report has no figure.
    """
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    rows = plan.join(reports, key).withColumn("_need", F.lower(c("required")).isin(*REQUIRED))
    there = ((c("title") != "") & F.contains(c("visible"), c("title"))) | ((c("data_file") != "") & F.contains(c("raw"), c("data_file")))
    lost = F.col("_need") & ~F.lower(c("status")).isin(*DROPPED) & ~there
    name = F.coalesce(F.nullif(c("visual_id"), F.lit("")), F.nullif(c("title"), F.lit("")), F.lit("(unnamed visual)"))
    chart = F.col("_need") & c("kind").rlike(CHART_LIKE) & (F.coalesce("figures", F.lit(0)) == 0)
    out = rows.groupBy(key).agg(F.count_if("_need").alias("n_required"), F.count_if(lost).alias("n_missing"), F.array_sort(F.collect_list(F.when(lost, name))).alias("_m"), F.bool_or(chart).alias("chart_missing"))
    return out.select(key, "n_required", "n_missing", F.array_join(F.slice("_m", 1, 8), " | ").alias("missing"), "chart_missing")


def as_number(value: Column, default: Column) -> Column:
    """A whole number written as text, else the default."""
    v = F.trim(value)
    return F.when(v.rlike(r"^[+-]?[0-9]{1,18}$"), v.cast("long")).otherwise(default)


def as_flag(value: Column, default: Column) -> Column:
    """True or false written as one of the known words, else the default."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*YES), True).when(v.isin(*NO), False).otherwise(default)


def export_findings(files: DataFrame, key: str) -> DataFrame:
    """(key, severity, rule) of exported files: kind, locked, valid, has_document, has_styles, mimetype, contract, strict, checks, renders."""
    return rules.findings(files, key, [(s, r, F.expr(c)) for s, r, c in EXPORT_RULES])
