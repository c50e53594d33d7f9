"""Findings, intake, profiles and small rules on odd rows: nulls, empties, repeats, empty tables."""

import pytest
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import evidence, factory, integrity, profiles, quality, route, units
from strata.sources import headers

FILES = "project string, path string, text string"
VISUALS = "project string, place int, columns array<string>, visual_id string, title string, purpose string, decision_use string, expected_reader_takeaway string, required string, status string, data_file string, source_record string"


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def rules_of(spark, files, visuals=(), **how):
    f = factory.findings(spark.createDataFrame([("p", *x) for x in files], FILES), spark.createDataFrame(list(visuals), VISUALS), ["full report"], how.pop("presets", ["memo"]), how.pop("legacy", []), **how)
    return [(r["severity"], r["rule"]) for r in f.orderBy("rule", "key").collect()]


def test_projects_that_lack_things(spark):
    assert rules_of(spark, [("notes.txt", None)]) == []
    bare = [("drafts/x.md", "A FULL report")]
    assert rules_of(spark, bare) == [("error", r) for r in ("chapters_missing", "cover_missing", "plan_missing", "prd_missing", "skeleton_missing", "toc_missing")]
    assert rules_of(spark, bare, strict=False) == [("error", "plan_missing"), ("error", "prd_missing"), ("warning", "skeleton_missing"), ("error", "toc_missing")]
    assert set(rules_of(spark, bare, legacy=["p"])) == {("warning", f"legacy:{r}") for r in ("chapters_missing", "cover_missing", "plan_missing", "prd_missing", "skeleton_missing", "toc_missing")}
    assert ("error", "toc_missing") in rules_of(spark, bare, legacy=["p"], modern=True)


def test_json_that_is_none_and_null_texts(spark):
    files = [("reports/a.html", 'data-assembled-report="true"'), (factory.MANIFEST, "{"), ("reports/chapters/ch01.html", None), ("reports/chapter_workpacks/ch01_workpack.md", None), (factory.PLAN, "x")]
    assert rules_of(spark, files) == [("error", r) for r in ("columns_missing", "integrity_missing", "manifest_mode", "workpack_thin", "workpack_thin")]
    none = spark.createDataFrame([], FILES)
    assert factory.findings(none, spark.createDataFrame([], VISUALS), [], [], []).collect() == []


def test_lists_of_visuals_are_cut_at_eight(spark):
    rows = [("p", i, list(factory.PLAN_COLUMNS), f"v{i}" if i % 2 else "", None, None, "use", "", "no", "done", None, None) for i in range(20)]
    f = factory.findings(spark.createDataFrame([("p", factory.PLAN, "x"), ("p", "data_sources/a.csv", None)], FILES), spark.createDataFrame(rows, VISUALS).repartition(3), [], [], [])
    keys = {r["rule"]: r["key"] for r in f.collect()}
    assert keys == {"roles_weak": "row_0 | v1 | row_2 | v3 | row_4 | v5 | row_6 | v7", "takeaway_weak": "row_0 | v1 | row_2 | v3 | row_4 | v5 | row_6 | v7"}


INDEX = "source_id string, status string, readiness string, title string, publisher string, url_or_path string, evidence_class string, original_verified string, reliability string, used_in string"
RECORDS = "source_id string, size int, text string, status string, readiness string, title string, publisher string, url_or_path string, evidence_class string, original_verified string, capture_path string, local_original_path string, source_locator string, exact_quote_location string"
LINKS = "source_id string, url string, url_status string, use_level string, source_locator string"


def test_sources_with_nothing_but_an_id(spark):
    index = spark.createDataFrame([("A", *[None] * 9), (None, *["x"] * 9), (" ` ", *[None] * 9), ("B", "report_citable", *[None] * 8)], INDEX)
    records = spark.createDataFrame([("A", *[None] * 13), ("C", *[None] * 13)], RECORDS)
    none = lambda s: spark.createDataFrame([], s)
    f = integrity.source_findings(index, records, none(LINKS), none("path string, text string"), none("source_id string, text string"))
    assert found(f, "source_id", "severity", "rule") == [("B", "error", "citable_without_record")]
    assert integrity.source_findings(none(INDEX), records, none(LINKS), none("path string, text string"), none("source_id string, text string")).collect() == []


def test_quotes_are_looked_for_in_their_own_evidence(spark):
    quote = "this sentence stands in the evidence of one source"
    text = f"h\n## 2. Exact Quotes\n- {quote}\n\n## 3. End\n- another line that is a quote nowhere at all"
    row = lambda i: (i, "report_citable", None, "t", None, "https://a.org/x/1", None, None, None, None)
    index = spark.createDataFrame([row("A"), row("B")], INDEX)
    records = spark.createDataFrame([(i, 5000, text, *[None] * 11) for i in "AB"], RECORDS)
    links = spark.createDataFrame([(i, "https://a.org/x/1", "ok", "quote_verified", "p1") for i in "AB"], LINKS)
    evidence = spark.createDataFrame([("A", f"long {quote} " * 3), ("B", "quite another text " * 9), ("B", f"[ Some Summary ]\n{quote}"), ("C", quote)], "source_id string, text string")
    f = integrity.source_findings(index, records, links, spark.createDataFrame([], "path string, text string"), evidence)
    assert found(f, "source_id", "rule") == [("B", "evidence_stub"), ("B", "quotes_unproved")]


def test_claims_with_odd_ids(spark):
    schema = "claim_id string, claim_type string, citation_type string, status string, source_ids string, evidence_class string, original_verified string, report_use_allowed string, exact_quote_location string, evidence_paths string, notes string"
    claims = spark.createDataFrame([("claim_id", *["x"] * 10), (None, *[None] * 10), ("`C1`", None, None, None, " `S1`; S2,,S2 , ", *[None] * 6)], schema)
    f = integrity.claim_findings(claims, spark.createDataFrame([("`S1`",), (None,)], "id string"))
    assert found(f, "claim_id", "rule", "key") == [("C1", "source_unknown", "S2")]


def test_intake_of_odd_files(spark):
    rows = [(1, "a/x.PDF", "## One #\n\nbody", None), (2, "x.pptx", "", None), (3, "x.docx", None, "IOError"), (4, ".pdf", "x", None), (5, None, "x", None), (6, "dir.pdf/x", "x", None), (7, "y.tif", "\n\n \n", None)]
    files = spark.createDataFrame(rows, "id int, path string, md string, err string")
    u = units.intake_units(files, "id", "path", "md")
    assert found(u, "id", "unit_type", "unit_no", "heading", "text") == [(1, "page", 1, "One", "## One #\n\nbody")]
    s = units.intake_states(files, u, "id", "path", "md", "err")
    assert found(s, "id", "normalized_status", "parse_status", "ocr_status", "context_unit_count", "page_count") == [
        (1, "normalized", "docling_parsed", "not_required", "1", "1"), (2, "normalized", "needs_ocr", "not_required", "0", "0"), (3, "error", "docling_error:IOError", "unknown", "", ""),
        *[(i, "not_supported", "not_supported", "not_required", "", "") for i in (4, 5, 6)], (7, "normalized", "needs_ocr", "unknown", "0", ""),
    ]


def test_profiles_of_nothing_and_repeats(spark):
    p = spark.createDataFrame([(1, "section_count", 1), (1, "section_count", 1), (1, "other", 9), (2, "bin_data_count", None), (3, "section_text_char_count", 5000)], "doc int, path string, value long")
    got = {r["doc"]: {k for k, v in r.asDict().items() if v is True} for r in profiles.flags(p).collect()}
    assert got == {1: {"multi_section"}, 2: set(), 3: {"long_text"}}
    other = spark.createDataFrame([(1, "section_count", 1), (2, "bin_data_count", 4), (9, "section_count", 1)], "doc int, path string, value long")
    assert found(profiles.likeness(p, other), "doc", "score", "exact") == [(1, 0.9643, 13), (2, 0.9286, 13)]
    none = p.limit(0)
    assert profiles.flags(none).collect() == profiles.likeness(none, p).collect() == []


def test_handing_over_and_originals(spark):
    paths = {"a.HTML": "", "x/token.md": quality.REASONS[1], "preserved_originals/secret.pdf": quality.REASONS[1], "Received_Originals/a.pdf": quality.REASONS[0], "a.exe": quality.REASONS[2], None: quality.REASONS[2]}
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", quality.handoff(F.col("p")).alias("h"))
    assert {r["i"]: (r["h"]["include"], r["h"]["reason"]) for r in df.collect()} == {i: (w == "", w) for i, w in enumerate(paths.values())}
    late = "가" * 99 + "\n[Some Heading]"
    heads = spark.createDataFrame([(1, "[Some Heading]"), (2, late), (3, "가" * 90 + "\n[Some Heading]"), (4, None)], "i int, t string").select("i", quality.stub_heading(F.col("t")).alias("s"))
    assert {r["i"]: r["s"] for r in heads.collect()} == {1: True, 2: False, 3: True, 4: False}


@pytest.mark.parametrize(("given", "want"), [("`x` # y", "x`"), (" `x` ", "x"), (" a (b) c", "a"), ("a#b", "a#b"), ("None", ""), (None, ""), ("`N/A`", ""), ("u // v | w", "u"), ("x\t|y", "x")])
def test_field_values(spark, given, want):
    assert spark.createDataFrame([(given,)], "c string").select(T.clean_field(F.col("c"))).collect()[0][0] == want


def test_ids_of_a_named_section(spark):
    text = "## 1. Evidence Inputs\n| source_id | x |\n|---|:--|\n| `S2` | y |\n|S1|\n| a b | c |\n| S3 open\n## Evidence Inputs again\n| S9 | z |"
    df = spark.createDataFrame([(text,), (None,), ("no section | S1 |",)], "t string").select(headers.named_ids(F.col("t"), "Evidence Inputs", "source_id").alias("i"))
    assert [r["i"] for r in df.collect()] == [["S1", "S2"], [], []]


def test_search_takes_wildcards_and_headings(spark):
    rows = [("b", "chunk", "2", "Cost 50% \\ up", "text", "9", "u"), ("a", "chunk", "1", None, "COST plan", "x", "u"), ("c", "chunk", "10", "", None, "", "u"), ("d", "page", "1", "cast", "t", "3", "u")]
    u = spark.createDataFrame(rows, "reference_id string, unit_type string, unit_no string, heading string, text string, token_estimate string, unit_path string")
    ids = lambda term: [r["reference_id"] for r in units.search_intake(u, term).collect()]
    assert ids("c_st") == ["d", "b", "a"] and ids("50% \\") == ["b"] and ids("zzz") == [] and ids("") == ["d", "b", "a", "c"]


def test_routes_beyond_a_block_of_cues(spark, monkeypatch):
    monkeypatch.setattr(evidence, "MOST_QUOTES", 3)
    cues = [(f"t{i}", i, "example", f"word{i:02d}") for i in range(20)] + [("t1", 1, "negative", "never"), ("t2", 2, "direct", None), ("t3", 3, "direct", "")]
    requests = [(1, "WORD01 please"), (2, "word01 never"), (3, "word05 word06"), (4, None), (5, "word07"), (5, "word07")]
    got = route.route(spark.createDataFrame(requests, "k int, text string"), spark.createDataFrame(cues, "target string, position int, kind string, cue string"), "k")
    assert found(got.distinct(), "k", "outcome", "target") == [(1, "matched", "t1"), (2, "matched", "t1"), (3, "ambiguous", "t5"), (4, "not_found", None), (5, "matched", "t7")]
