"""Bytes of unknown charsets as text: the first charset of an ordered list that fits them strictly."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.batches import slices
from strata.functions.shipping import ship

#: Charsets tried after a declared one (fixed values, in order).
CHARSETS = ("utf-8", "cp949", "euc-kr", "latin-1")
#: Bytes that are decoded at a time.
SLICE = 2 << 20


def declared(content_type: Column) -> Column:
    """The charset that a content type names, quote marks off; null where it names none."""
    found = F.regexp_extract(content_type, r"(?i)charset=([^;\s]+)", 1)
    return F.nullif(F.regexp_replace(found, '^"+|"+$', ""), F.lit(""))


def _known(name: str | None) -> bool:
    try:
        return bool(name) and codecs.lookup(name)._is_text_encoding
    except (LookupError, ValueError):
        return False


def _first(raw: bytes, order: list[str]) -> tuple[str, str]:
    for name in order:
        try:
            return raw.decode(name), name
        except (UnicodeError, ValueError):
            continue
    return raw.decode("utf-8", "replace"), "replaced"


def decoded(df: DataFrame, column: str, named: str | None = None, charsets: tuple[str, ...] = CHARSETS) -> DataFrame:
    """df with ``text`` and ``charset``: the charset named in a row first, if it is known, then the list.

    Decoding is strict: a charset that leaves a byte over does not fit. Where none fits, the text is UTF-8 with
    replacement characters and the charset is ``replaced``. A batch that is UTF-8 throughout, with no other
    charset named and UTF-8 first in the list, is taken as it is, without a step a row. A null stays null.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("text", T.StringType()), T.StructField("charset", T.StringType())])

    def work(batches):
        for batch in slices(batches, SLICE, column):
            body = batch.column(batch.schema.get_field_index(column))
            names = batch.column(batch.schema.get_field_index(named)).to_pylist() if named else [None] * batch.num_rows
            text = None
            if charsets[:1] == ("utf-8",) and not any(names):
                try:
                    text = body.cast(pa.string())
                    name = pa.array([charsets[0] if v else None for v in body.is_valid().to_pylist()], pa.string())
                except pa.ArrowInvalid:
                    pass
            if text is None:
                rows = [(None, None) if b is None else _first(b, [*([n] if _known(n) else []), *charsets]) for b, n in zip(body.to_pylist(), names, strict=True)]
                # what is no Unicode text, as half pairs of surrogates, has no place in a column of texts
                text = pa.array([t if t is None else t.encode("utf-8", "replace").decode() for t, _ in rows], pa.string())
                name = pa.array([n for _, n in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text, name], names=[*batch.schema.names, "text", "charset"])

    return df.mapInArrow(work, schema)
