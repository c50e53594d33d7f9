"""Structural rules between paired documents: each compares a count of one document with a count of the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import relation

#: Rules by name, priority, path in the source's profile, path in the target's, and the producer they are for (None: any).
RULES = (
    ("sections.hwp_body_streams_to_hwpx_sections", "high", "body.section_stream_count", "section_count", None),
    ("sections.hwp_doc_properties_to_hwpx_sections", "high", "doc_info.doc_properties.section_count", "section_count", None),
    ("paragraphs.para_header_to_hwpx_p", "high", "body.aggregate.para_header_signals.paragraph_count", "section_aggregate_tags.p", None),
    ("text.para_declared_chars_to_hwpx_text_chars", "high", "body.aggregate.para_header_signals.declared_char_count", "section_text_char_count", None),
    ("text.para_text_records_to_hwpx_text_nodes", "medium", "body.aggregate.tag_counts.PARA_TEXT", "section_aggregate_tags.t", None),
    ("runs.para_char_shape_runs_to_hwpx_runs", "high", "body.aggregate.para_header_signals.char_shape_run_count", "section_aggregate_tags.run", None),
    ("runs.para_char_shape_records_to_hwpx_runs", "high", "body.aggregate.style_signals.para_char_shape_run_count", "section_aggregate_tags.run", None),
    ("layout.para_line_seg_to_hwpx_lineseg", "high", "body.aggregate.layout_signals.line_segment_count", "section_aggregate_tags.lineseg", None),
    ("tables.table_record_to_hwpx_tbl", "high", "body.aggregate.layout_signals.table_record_count", "section_aggregate_tags.tbl", None),
    ("tables.table_record_rows_to_hwpx_tr", "high", "body.aggregate.layout_signals.table_row_count", "section_aggregate_tags.tr", None),
    ("tables.table_record_cell_array_to_hwpx_tc", "high", "body.aggregate.layout_signals.table_cell_count", "section_aggregate_tags.tc", None),
    ("tables.list_header_to_hwpx_sub_list", "high", "body.aggregate.layout_signals.list_header_record_count", "section_aggregate_tags.subList", None),
    ("objects.picture_record_to_hwpx_bindata_entries", "medium", "body.aggregate.layout_signals.picture_record_count", "bin_data_count", None),
    ("objects.picture_record_to_hwpx_pic_tags", "medium", "body.aggregate.layout_signals.picture_record_count", "section_aggregate_tags.pic", None),
    ("objects.ctrl_header_to_hwpx_ctrl_tags", "medium", "body.aggregate.layout_signals.ctrl_header_record_count", "section_aggregate_tags.ctrl", None),
    ("package.bindata_streams_to_hwpx_bindata_entries", "medium", "stream_inventory.bin_data_stream_count", "bin_data_count", None),
    ("package.docinfo_bindata_records_to_hwpx_bindata_entries", "medium", "doc_info.tag_counts.BIN_DATA", "bin_data_count", None),
    ("package.id_mapping_bindata_to_hwpx_bindata_entries", "medium", "doc_info.id_mappings.bin_data", "bin_data_count", None),
    ("page.page_def_to_section_layout", "high", "body.aggregate.layout_signals.page_def_record_count", "section_count", None),
    ("page.page_def_to_hwpx_page_pr", "high", "body.aggregate.layout_signals.page_def_record_count", "section_aggregate_tags.pagePr", None),
    ("page.page_def_width_to_hwpx_page_pr_width", "high", "body.aggregate.layout_signals.page_width_sum", "section_page_geometry_sums.width", None),
    ("page.page_def_height_to_hwpx_page_pr_height", "high", "body.aggregate.layout_signals.page_height_sum", "section_page_geometry_sums.height", None),
    ("page.page_def_margins_to_hwpx_margin_attrs", "high", "body.aggregate.layout_signals.page_margin_sum", "section_page_geometry_sums.margin", None),
    ("page.page_def_to_hwpx_sec_pr", "high", "body.aggregate.layout_signals.page_def_record_count", "section_aggregate_tags.secPr", None),
    ("lists.numbering_to_hwpx_numbering", "medium", "doc_info.tag_counts.NUMBERING", "aggregate_tags.numbering", None),
    ("lists.bullet_to_hwpx_bullet", "medium", "doc_info.tag_counts.BULLET", "aggregate_tags.bullet", None),
    ("styles.char_shape_to_hwpx_char_pr", "medium", "doc_info.tag_counts.CHAR_SHAPE", "aggregate_tags.charPr", None),
    ("styles.id_mapping_char_shape_to_hwpx_char_pr", "medium", "doc_info.id_mappings.char_shape", "aggregate_tags.charPr", None),
    ("styles.distinct_char_shape_refs_to_hwpx_char_pr", "medium", "body.aggregate.style_signals.distinct_char_shape_ref_count", "aggregate_tags.charPr", None),
    ("styles.para_shape_to_hwpx_para_pr", "medium", "doc_info.tag_counts.PARA_SHAPE", "aggregate_tags.paraPr", None),
    ("styles.id_mapping_para_shape_to_hwpx_para_pr", "medium", "doc_info.id_mappings.para_shape", "aggregate_tags.paraPr", None),
    ("styles.distinct_para_shape_refs_to_hwpx_para_pr", "medium", "body.aggregate.style_signals.distinct_para_shape_ref_count", "aggregate_tags.paraPr", None),
    ("styles.style_records_to_hwpx_style_tags", "low", "doc_info.tag_counts.STYLE", "aggregate_tags.style", None),
    ("objects.page_hiding_ctrl_to_hwpx_page_hiding", "medium", "body.aggregate.layout_details.layout_control_child_counts.pageHiding", "section_ctrl_child_counts.pageHiding", None),
    ("objects.page_num_ctrl_to_hwpx_page_num", "medium", "body.aggregate.layout_details.layout_control_child_counts.pageNum", "section_ctrl_child_counts.pageNum", None),
    ("objects.new_num_ctrl_to_hwpx_new_num", "medium", "body.aggregate.layout_details.layout_control_child_counts.newNum", "section_ctrl_child_counts.newNum", None),
    ("objects.header_ctrl_to_hwpx_header", "medium", "body.aggregate.layout_details.layout_control_child_counts.header", "section_ctrl_child_counts.header", None),
    ("objects.section_ctrl_to_conservative_hwpx_col_pr", "medium", "body.aggregate.layout_details.control_id_counts.dces", "section_ctrl_child_counts.colPr", None),
    ("objects.dloc_to_hwpx_col_pr_hancom_profile", "high", "body.aggregate.layout_details.control_id_counts.dloc", "section_ctrl_child_counts.colPr", "hancom"),
    ("objects.dces_to_hwpx_col_pr_portable_profile", "high", "body.aggregate.layout_details.control_id_counts.dces", "section_ctrl_child_counts.colPr", "portable"),
    ("objects.field_ctrl_ids_to_hwpx_field_begin", "high", "body.aggregate.layout_details.layout_control_child_counts.fieldBegin", "section_ctrl_child_counts.fieldBegin", None),
    ("objects.field_ctrl_ids_to_hwpx_field_end", "high", "body.aggregate.layout_details.layout_control_child_counts.fieldEnd", "section_ctrl_child_counts.fieldEnd", None),
)
#: Maps of counts: what such a map lacks counts as 0, what any other map lacks is missing.
COUNT_MAPS = ("layout_control_child_counts", "section_ctrl_child_counts")
#: Confidence by score, from the highest.
BANDS = ((0.95, "high_confidence"), (0.75, "medium_confidence"), (0.45, "weak_signal"))


def observations(pairs: DataFrame, profiles: DataFrame, rules=RULES) -> DataFrame:
    """(pair, rule_id, source_value, target_value, relation, delta) of every pair under every rule.

    ``pairs`` are (pair, producer), ``profiles`` rows (pair, side, path, value) with side source or target and dotted
    paths. A rule for another producer is not_applicable. A pair's counts come together in two maps of the
    paths that rules name, so that there is one shuffle however many rules there are. Of rows that repeat a path
    the greatest value counts; a value that is no whole number is missing.
    """
    sides = {"source": sorted({r[2] for r in rules}), "target": sorted({r[3] for r in rules})}
    mine = [(F.col("side") == side) & F.col("path").isin(*paths) for side, paths in sides.items()]
    rows = profiles.filter((mine[0] | mine[1]) & F.col("pair").isNotNull()).groupBy("pair", "side", "path").agg(F.max(F.col("value").try_cast("bigint")).alias("value"))
    each = F.struct("path", "value")
    maps = rows.groupBy("pair").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("side") == side, each))).alias(side) for side in sides])
    j = pairs.join(maps, "pair", "left")
    table = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("rule_id", "priority", "source_path", "target_path", "only"), r, strict=True)]) for r in rules])
    r = j.withColumn("r", F.explode(table)).select("pair", "producer", "source", "target", "r.*")
    here = F.col("only").isNull() | (F.col("only") == F.coalesce("producer", F.lit("")))

    def value(side: str):
        path = F.col(f"{side}_path")
        counted = F.coalesce(F.get(F.slice(F.split(path, r"\."), -2, 1), F.lit(0)).isin(*COUNT_MAPS), F.lit(False))  # a path of one part lies in no map
        found = F.try_element_at(F.col(side), path)
        lacks = ~F.coalesce(F.map_contains_key(F.col(side), path), F.lit(False))
        return F.when(here, F.when(lacks & counted, 0).otherwise(found))

    v = r.select("pair", "rule_id", "priority", here.alias("_here"), value("source").alias("source_value"), value("target").alias("target_value"))
    a, b = F.col("source_value"), F.col("target_value")
    return v.select("pair", "rule_id", "priority", a, b, F.when(F.col("_here"), relation(a, b)).otherwise("not_applicable").alias("relation"), (b - a).alias("delta"))


def report(observed: DataFrame, samples: int = 8) -> DataFrame:
    """Every rule's relations counted, its confidence, and the deltas of the first pairs compared, in order of pair.

    The score is the share of exact relations among those compared, with 0.7 for close ones and 0.4 for counts
    that are both there; four places, halves to even.
    """
    n = lambda *names: F.count_if(F.col("relation").isin(*names))
    by = observed.groupBy("rule_id", "priority").agg(
        F.count_if(F.col("delta").isNotNull()).alias("compared"), n("exact").alias("exact"), n("close").alias("close"), n("both_present").alias("both_present"), n("source_only").alias("source_only"),
        n("target_only").alias("target_only"), n("missing_signal").alias("missing"), n("not_applicable").alias("not_applicable"),
    )
    w = Window.partitionBy("rule_id").orderBy("pair")
    first = observed.filter("delta is not null").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= samples)
    deltas = first.groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "delta"))), lambda s: s["delta"].cast("string")), ",").alias("deltas"))
    score = F.coalesce(F.bround((F.col("exact") + F.col("close") * F.lit(0.7) + F.col("both_present") * F.lit(0.4)) / F.nullif(F.col("compared"), F.lit(0)), 4), F.lit(0.0))
    band = F.lit("exploratory")
    for least, name in reversed(BANDS):
        band = F.when(F.col("score") >= least, name).otherwise(band)
    return by.join(deltas, "rule_id", "left").withColumn("score", score).withColumn("band", band).withColumn("deltas", F.coalesce("deltas", F.lit("")))
