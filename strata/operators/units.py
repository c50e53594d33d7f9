"""Document units: chunking, counting and searching."""

from __future__ import annotations

from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.batches import slices
from strata.functions.shipping import ship
from strata.functions.text import strip, token_estimate

MOST, LEAST = 4000, 800
#: Bytes of texts that are cut into units at a time.
SLICE = 2 << 20


def next_break(body: str, at: int, most: int, least: int) -> int:
    """Where a piece that begins at ``at`` ends: the last blank line more than ``least`` in, else ``most`` further on."""
    if len(body) - at <= most:
        return len(body)
    blank = body.rfind("\n\n", at + least + 1, at + most)
    return blank if blank >= 0 else at + most


def chunk_text(text: str, most: int = MOST, least: int = LEAST) -> list[str]:
    """Pieces of at most ``most`` characters of the stripped text, each stripped; empty ones are left out."""
    body, places = text.strip(), [0]
    while places[-1] < len(body):
        places.append(next_break(body, places[-1], most, least))
    return [piece for a, b in pairwise(places) if (piece := body[a:b].strip())]


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit_no, unit_text): the units of every text, one Arrow pass without a shuffle."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def apply(batches):
        for batch in slices(batches, SLICE, text):
            rows = [(k, i, u) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, u in enumerate(chunk_text(t or ""), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=[key, "unit_no", "unit_text"])

    return docs.select(key, text).mapInArrow(apply, f"{key} {kind}, unit_no int, unit_text string")


def search(units: DataFrame, term: str, limit: int = 8, preview: int = 1200) -> DataFrame:
    """Units that contain the term in any case, cheapest first; ties by key and number."""
    hit = F.contains(F.lower(F.coalesce("unit_text", F.lit(""))), F.lit(term.lower()))
    found = units.filter(hit).select("doc_id", "unit_no", token_estimate(F.col("unit_text")).alias("token_estimate"), F.substring("unit_text", 1, preview).alias("preview"))
    return found.orderBy("token_estimate", "doc_id", "unit_no").limit(limit)




#: Suffixes that a document converter reads, those among them that are images, and the units of others than chunks.
CONVERTED = (".pdf", ".pptx", ".docx", ".xlsx", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
UNIT_TYPES = {".pptx": "slide", ".pdf": "page"}


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"[^/.][^/]*?(\.[^./]+)$", 1))


def intake_units(files: DataFrame, key: str, path: str, markdown: str) -> DataFrame:
    """(key, unit_type, unit_no, heading, text, token_estimate) of converted files; heading is a unit's first line that is not blank, without # around it."""
    suffix = _suffix(F.col(path))
    ok = files.filter(suffix.isin(*CONVERTED) & F.col(markdown).isNotNull())
    kind = F.coalesce(*[F.when(suffix == s, t) for s, t in UNIT_TYPES.items()], F.lit("chunk"))
    units = chunk(ok.select(F.struct(F.col(key), kind.alias("unit_type")).alias("k"), F.col(markdown).alias("text")), "k", "text")
    first = F.regexp_extract("unit_text", r"(?U)^\s*([^\n]*)", 1)
    heading = strip(F.regexp_replace(first, r"^[# ]+|[# ]+$", ""))
    return units.select(f"k.{key}", "k.unit_type", "unit_no", F.substring(heading, 1, 160).alias("heading"), F.col("unit_text").alias("text"), token_estimate(F.col("unit_text")).alias("token_estimate"))


def intake_states(files: DataFrame, units: DataFrame, key: str, path: str, markdown: str, error: str) -> DataFrame:
    """What became of every file, as columns of its inventory row: a failed conversion is a state and not an error.

    A suffix that the converter does not read is not_supported; a named error gives docling_error with its name;
    markdown without text needs_ocr. Units are counted from ``units``; pages and slides are counted as pages too.
    """
    n = units.groupBy(key).agg(F.count("*").alias("_n"))
    f = files.join(n, key, "left")
    suffix, units_n = _suffix(F.col(path)), F.coalesce("_n", F.lit(0))
    reads, failed = suffix.isin(*CONVERTED), F.col(error).isNotNull()
    base = F.concat(F.lit("references/normalized/"), F.col(key).cast("string"))
    state = lambda no, bad, good: F.when(~reads, no).when(failed, bad).otherwise(good)
    return f.select(
        key, state("not_supported", "error", "normalized").alias("normalized_status"), state("not_supported", F.concat(F.lit("docling_error:"), F.col(error)), F.when(strip(F.coalesce(markdown, F.lit(""))) == "", "needs_ocr").otherwise("docling_parsed")).alias("parse_status"),
        state("not_required", "unknown", F.when(suffix.isin(*IMAGES), "unknown").otherwise("not_required")).alias("ocr_status"), state("not_indexed", "not_indexed", "pending_index").alias("context_index_status"),
        state("", "", units_n.cast("string")).alias("context_unit_count"), state("", "", F.when(suffix.isin(*UNIT_TYPES), units_n.cast("string")).otherwise("")).alias("page_count"),
        state(F.lit(""), F.concat(base, F.lit("/manifest.json")), F.concat(base, F.lit("/manifest.json"))).alias("manifest_path"),
    )


def search_intake(units: DataFrame, term: str, limit: int = 8, preview: int = 1200) -> DataFrame:
    """Units whose text or heading is like %term% in lower case, % and _ standing for anything; cheapest first, those without an estimate last, ties by id and number.

    ``units`` are (reference_id, unit_type, unit_no, heading, text, token_estimate, unit_path) as texts.
    """
    pattern = f"%{term.lower()}%".replace("\\", "\\\\")
    like = lambda c: F.lower(F.coalesce(c, F.lit(""))).like(pattern)
    cost = F.nullif("token_estimate", F.lit("")).try_cast("int")
    rows = units.filter(like("text") | like("heading")).select("reference_id", "unit_type", "unit_no", "heading", "token_estimate", "unit_path", F.substring("text", 1, preview).alias("text_preview"))
    return rows.orderBy(cost.asc_nulls_last(), "reference_id", F.col("unit_no").cast("int")).limit(limit)
