"""Profiles of documents as rows of counts: feature flags, likeness of two profiles by metrics, and what a corpus of comparisons adds up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A flag is set if any of its counts is at least so great. Counts by dotted path; those of sections add up.
FLAGS = (
    ("multi_section", ("section_count",), 2),
    ("long_text", ("section_text_char_count",), 5000),
    ("rich_character_styles", ("style_semantics.counts.char_shape_count",), 24),
    ("rich_paragraph_styles", ("style_semantics.counts.para_shape_count",), 24),
    ("lists", ("section_aggregate_tags.numbering", "section_aggregate_tags.bullet"), 1),
    ("tables", ("table_semantics.table_count",), 1),
    ("merged_or_nested_tables", ("table_semantics.merged_cell_count", "table_semantics.nested_table_count"), 1),
    ("table_captions", ("table_semantics.caption_count",), 1),
    ("binary_data", ("bin_data_count",), 1),
    ("pictures", ("object_semantics.picture_count",), 1),
    ("shapes", ("object_semantics.shape_count",), 1),
    ("columns", ("section_aggregate_tags.colPr",), 1),
    ("headers_or_footers", ("section_ctrl_child_counts.header", "section_ctrl_child_counts.footer"), 1),
    ("footnotes", ("footnote_control_semantics.footnote_count",), 1),
    ("fields", ("section_aggregate_tags.fieldBegin", "section_aggregate_tags.fieldEnd"), 1),
    ("page_numbering", ("section_aggregate_tags.pageNum", "section_aggregate_tags.autoNum"), 1),
    ("inline_controls", tuple(f"section_aggregate_tags.{t}" for t in ("tab", "lineBreak", "hyphen", "nbSpace", "fwSpace")), 1),
    ("compose_controls", ("compose_semantics.compose_count",), 1),
    ("page_hiding", ("page_hiding_semantics.page_hiding_count",), 1),
)
#: Metrics by name and the counts that add up to them.
METRICS = (
    ("section_count", ("section_count",)),
    ("paragraph_count", ("section_aggregate_tags.p",)),
    ("run_count", ("section_aggregate_tags.run",)),
    ("line_segment_count", ("section_aggregate_tags.lineseg",)),
    ("table_count", ("section_aggregate_tags.tbl",)),
    ("table_row_count", ("section_aggregate_tags.tr",)),
    ("table_cell_count", ("section_aggregate_tags.tc",)),
    ("sub_list_count", ("section_aggregate_tags.subList",)),
    ("picture_count", ("section_aggregate_tags.pic",)),
    ("page_property_count", ("section_aggregate_tags.pagePr",)),
    ("page_width_sum", ("section_page_geometries.width",)),
    ("page_height_sum", ("section_page_geometries.height",)),
    ("page_margin_sum", tuple(f"section_page_geometries.margin.{s}" for s in ("left", "right", "top", "bottom", "header", "footer", "gutter"))),
    ("binary_count", ("bin_data_count",)),
)


def flags(profiles: DataFrame, table=FLAGS) -> DataFrame:
    """(doc, the flags) of profiles (doc, path, value): values of a path add up, what a profile lacks is 0.

    The paths of all flags are counted in one aggregate, whatever their number.
    """
    known = sorted({p for _, paths, _ in table for p in paths})
    total = profiles.groupBy("doc", "path").agg(F.sum(F.when(F.col("path").isin(*known), F.col("value"))).alias("n"))
    return total.groupBy("doc").agg(*[F.coalesce(F.max(F.when(F.col("path").isin(*paths), F.col("n") >= least)), F.lit(False)).alias(name) for name, paths, least in table])


def metric_scores(gold: DataFrame, made: DataFrame, table=METRICS) -> DataFrame:
    """(doc, metric, gold, made, score) of the documents that both sides profile, for metrics that either has; the score falls with the difference relative to the greater."""
    name = F.lit(None).cast("string")
    for metric, paths in table:
        name = F.when(F.col("path").isin(*paths), metric).otherwise(name)
    side = lambda df, s: df.select("doc", name.alias("metric"), *[(F.col("value") if s == k else F.lit(None).cast("long")).alias(k) for k in ("gold", "made")], F.lit(s).alias("_side"))
    rows = side(gold, "gold").unionByName(side(made, "made"))
    both = rows.groupBy("doc").agg(F.count_distinct("_side").alias("_n")).filter("_n = 2").drop("_n")
    n = rows.filter("metric is not null").groupBy("doc", "metric").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("gold", "made")])
    scale = F.greatest(F.lit(1), F.abs("gold"), F.abs("made"))
    return n.join(both, "doc", "left_semi").withColumn("score", F.bround(F.greatest(F.lit(0.0), 1 - F.abs(F.col("gold") - F.col("made")) / scale), 4))


def likeness(gold: DataFrame, made: DataFrame, table=METRICS) -> DataFrame:
    """(doc, score, exact) of the documents that both sides profile: the mean of all metrics' scores, and how many are equal; a metric that both lack is equal."""
    s = metric_scores(gold, made, table)
    # scores have four places: they add up as whole numbers, in any order
    per = s.groupBy("doc").agg(F.sum(F.round(F.col("score") * 10000).cast("long")).alias("_sum"), F.count("*").alias("_n"), F.count_if(F.col("gold") == F.col("made")).alias("_exact"))
    docs = gold.select("doc").distinct().join(made.select("doc"), "doc", "left_semi")
    lacks = F.lit(len(table)) - F.coalesce("_n", F.lit(0))
    return docs.join(per, "doc", "left").select("doc", (F.bround((F.coalesce("_sum", F.lit(0)) + lacks * 10000) / len(table)) / 10000).alias("score"), (F.coalesce("_exact", F.lit(0)) + lacks).alias("exact"))


def rolled_up(scores: DataFrame, likeness: DataFrame, passing: float = 0.95) -> DataFrame:
    """(metric, docs, exact, mean, least): each metric over the documents that have it, and ``all`` over the documents' own scores.

    For ``all``, exact counts the documents at ``passing`` or above.
    """
    each = scores.groupBy("metric").agg(F.count("*").alias("docs"), F.count_if(F.col("gold") == F.col("made")).alias("exact"), F.bround(F.avg("score"), 4).alias("mean"), F.min("score").alias("least"))
    whole = likeness.agg(F.count("*").alias("docs"), F.count_if(F.col("score") >= passing).alias("exact"), F.bround(F.avg("score"), 4).alias("mean"), F.min("score").alias("least"))
    return each.unionByName(whole.select(F.lit("all").alias("metric"), "*"))
