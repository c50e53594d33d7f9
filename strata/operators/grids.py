"""Tables of a document's record stream: cells with spans on a grid, captions, owners of nested tables.

In the stream a table is a control record; below it, on one level, come the caption's list header with its
paragraphs, the table record, and a list header for each cell with the cell's paragraphs. Tables in a cell hang
below one of its paragraphs, at any depth. All of it follows from each record's parent and the records before
it under the same parent, so that only finding the parents needs the order of a whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import trees
from strata.sources.packed import bit, number, once

#: Fixed values of the public format: names of records, bytes of a cell's list header, ways to break a table.
PARAGRAPH, LIST, TABLE = "PARA_HEADER", "LIST_HEADER", "TABLE"
CELL_BYTES, WHOLE_CELL_BYTES = 34, 47
BREAKS = ("NONE", "TABLE", "CELL", "CELL")


def table_fields(df: DataFrame) -> DataFrame:
    """df with the fields of a table record's body: rows, columns, declared cells, break, header flag, zones and status.

    A body that is too short for its fields, or for the cell counts of its rows, is a table of one row and one
    column of one cell: ``short_body``; one that is longer or shorter than its zones say has ``size_mismatch``.
    """
    b = F.col("body")

    def read(h: Column, zones: Column) -> Column:
        tail = 18 + h["rows"] * 2
        fits = (F.octet_length(b) >= 22) & (h["rows"] > 0) & (h["columns"] > 0) & (F.octet_length(b) >= tail + 4)
        counts = F.aggregate(F.sequence(F.lit(0), F.greatest(h["rows"] - 1, F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(number(b, 18 + i * 2, 2), F.lit(0)))
        n_zones = F.shiftright(zones, 16)  # border and number of zones together
        whole = F.octet_length(b) == tail + 4 + n_zones * 10
        return F.when(fits, F.struct(h["rows"].alias("rows"), h["columns"].alias("columns"), counts.alias("declared"), h["flags"].alias("flags"), n_zones.alias("zones"), whole.alias("whole")))

    head = F.struct(number(b, 0, 4).alias("flags"), number(b, 4, 2).alias("rows"), number(b, 6, 2).alias("columns"))
    df = df.withColumn("_t", once(head, lambda h: once(number(b, 18 + h["rows"] * 2, 4), lambda zones: read(h, zones))))
    t, fits = F.col("_t"), F.col("_t").isNotNull()
    ok = lambda c, other: F.when(fits, c).otherwise(F.lit(other))
    return df.select(
        "*", ok(t["rows"], 1).alias("rows"), ok(t["columns"], 1).alias("columns"), ok(t["declared"], 1).alias("declared"), ok(F.get(F.array(*map(F.lit, BREAKS)), t["flags"].bitwiseAND(F.lit(3)).cast("int")), "NONE").alias("page_break"),
        ok(bit(t["flags"], 2), False).alias("repeat_header"), ok(t["zones"], 0).alias("zones"), F.when(~fits, "short_body").when(t["whole"], "parsed").otherwise("size_mismatch").alias("status"),
    ).drop("_t")


def placed(records: DataFrame, key: str) -> DataFrame:
    """Records (key, idx, tag, level, body) with ``parent1``, ``parent2`` and ``depth``, the table and cell they stand in.

    ``table_at`` is the last table record before or at a record under the same parent, ``cell_at`` the last header
    of a cell after it, ``header_at`` the last list header of any kind. A header is a cell's if its place lies on
    the table and its spans are one or more.
    """
    r = trees.parents(records.select(key, F.col("idx").cast("long").alias("idx"), "tag", "level", "body"), key, "idx", "level", up=2)
    w = Window.partitionBy(key, "parent1").orderBy("idx")
    b = F.col("body")
    is_table = F.col("tag") == TABLE
    fits = lambda b, s: (F.octet_length(b) >= 22) & (s["rows"] > 0) & (s["columns"] > 0) & (F.octet_length(b) >= 22 + s["rows"] * 2)
    read = F.struct(number(b, 4, 2).alias("rows"), number(b, 6, 2).alias("columns"))
    size = once(read, lambda s: F.when(fits(b, s), s).otherwise(F.struct(F.lit(1).cast("long").alias("rows"), F.lit(1).cast("long").alias("columns"))))
    r = r.withColumn("table_at", F.last(F.when(is_table, F.col("idx")), True).over(w)).withColumn("_size", F.last(F.when(is_table, size), True).over(w))
    is_list = F.col("tag") == LIST
    # column and row, then both spans, two bytes each
    on = once(number(b, 8, 4), lambda p: (p.bitwiseAND(F.lit(65535)) < F.col("_size.columns")) & (F.shiftright(p, 16) < F.col("_size.rows")))
    spans = once(number(b, 12, 4), lambda p: (p.bitwiseAND(F.lit(65535)) >= 1) & (F.shiftright(p, 16) >= 1))
    cell = is_list & F.col("table_at").isNotNull() & (F.octet_length(b) >= CELL_BYTES) & on & spans
    r = r.withColumn("_cell", F.coalesce(cell, F.lit(False)))
    last = lambda c: F.last(F.when(c, F.col("idx")), True).over(w)
    r = r.select("*", last(F.col("_cell")).alias("_cell_at"), last(is_list).alias("header_at"))
    return r.withColumn("cell_at", F.when(F.col("_cell_at") > F.col("table_at"), F.col("_cell_at"))).drop("_cell_at", "_size")


def cells(placed: DataFrame, key: str) -> DataFrame:
    """(key, table_at, cell_no, row, column, row_span, column_span, header, paragraphs, whole) of every cell.

    Cells are numbered from 0 in the order of the stream; ``paragraphs`` are those right in the cell, not those of
    tables within it; ``whole`` says whether the header has its full size.
    """
    b = F.col("body")
    own = placed.filter("cell_at is not null").groupBy(key, "table_at", "cell_at").agg(F.count_if(F.col("tag") == PARAGRAPH).alias("paragraphs"))
    heads = placed.filter("_cell").select(
        key, "table_at", F.col("idx").alias("cell_at"), (F.row_number().over(Window.partitionBy(key, "table_at").orderBy("idx")) - 1).alias("cell_no"), number(b, 10, 2).alias("row"), number(b, 8, 2).alias("column"),
        number(b, 14, 2).alias("row_span"), number(b, 12, 2).alias("column_span"), bit(number(b, 6, 2), 2).alias("header"), (F.octet_length(b) == WHOLE_CELL_BYTES).alias("whole"),
    )
    return heads.join(own, [key, "table_at", "cell_at"], "left").withColumn("paragraphs", F.coalesce("paragraphs", F.lit(0)))


def swept(cells: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, table_at, cell_at, slots, overlaps) of every cell: places it covers on the table, and whether any of them belongs to a cell further left or before it.

    A sweep over the rows of a table: in each row, a cell overlaps if it begins before the farthest end of
    those that begin before it. Cells are spread over the rows they cover, within the table, and not over places;
    ``slots`` counts those not yet covered, so that their sum is what the cells cover together.
    """
    c = cells.join(sizes.select(key, "table_at", "rows", "columns"), [key, "table_at"])
    last_row = F.least(F.col("row") + F.col("row_span"), F.col("rows")) - 1
    spread = c.select(key, "table_at", "cell_at", F.explode(F.sequence("row", last_row)).alias("_row"), "column", F.least(F.col("column") + F.col("column_span"), F.col("columns")).alias("_end"))
    before = Window.partitionBy(key, "table_at", "_row").orderBy("column", "cell_at").rowsBetween(Window.unboundedPreceding, -1)
    line = spread.withColumn("_far", F.coalesce(F.max("_end").over(before), F.lit(0)))
    fresh = F.greatest(F.col("_end") - F.greatest("column", "_far"), F.lit(0))
    return line.groupBy(key, "table_at", "cell_at").agg(F.sum(fresh).alias("slots"), F.max(F.col("column") < F.col("_far")).alias("overlaps"))


def tables(placed: DataFrame, key: str) -> DataFrame:
    """Every table: its number in the document, fields, cells, caption paragraphs, owner and cover.

    ``owner_at`` and ``owner_cell_at`` are the table and cell that hold the paragraph which the table's control
    hangs below, null for a table outside of tables. A table whose cells are not as many as its rows declare
    has ``cell_count_mismatch``. ``covered`` counts the places on the grid that cells cover, ``overlapping`` the
    cells that cover a place again.
    """
    t = table_fields(placed.filter(F.col("tag") == TABLE)).select(key, "table_at", "parent1", "parent2", "depth", "rows", "columns", "declared", "page_break", "repeat_header", "zones", "status")
    c = cells(placed, key)
    cover = swept(c, t, key).groupBy(key, "table_at").agg(F.count("*").alias("n_cells"), F.sum("slots").alias("covered"), F.count_if("overlaps").alias("overlapping"))
    caption = placed.filter((F.col("tag") == PARAGRAPH) & F.col("table_at").isNull() & F.col("header_at").isNotNull()).groupBy(key, "parent1").agg(F.count("*").alias("caption_paragraphs"))
    # what stands in a cell: the paragraph that a control hangs below
    held = placed.filter("cell_at is not null").select(key, F.col("idx").alias("parent2"), F.col("table_at").alias("owner_at"), F.col("cell_at").alias("owner_cell_at"))
    out = t.join(held, [key, "parent2"], "left").join(caption, [key, "parent1"], "left").join(cover, [key, "table_at"], "left")
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_cells", "covered", "overlapping", "caption_paragraphs")]
    status = F.when((F.col("status") == "parsed") & (F.coalesce("n_cells", F.lit(0)) != F.col("declared")), "cell_count_mismatch").otherwise(F.col("status"))
    number_of = F.row_number().over(Window.partitionBy(key).orderBy("table_at")) - 1
    return out.select(key, "table_at", number_of.alias("table_no"), "rows", "columns", "declared", "page_break", "repeat_header", "zones", status.alias("status"), "owner_at", "owner_cell_at", *zero)
