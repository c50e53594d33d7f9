"""Paragraph texts of 16-bit units in which controls stand between the characters.

A control takes one unit or eight, of which seven may look like text. Which units begin a control follows from
the controls before: among the candidates of a text the first is one, and the next is the first candidate
beyond its eight units. Only candidates are stepped through; everything else is arithmetic on the units of a
whole batch. A prefix sum of the visible widths maps each place of the source to a place of the visible text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strata.functions.batches import slices
from strata.functions.shipping import ship

#: Fixed values of the public format: codes of controls of eight units, and of those of one unit that can be seen.
INLINE = (4, 5, 6, 7, 8, 9, 19, 20)
EXTENDED = (1, 2, 3, 11, 12, 14, 15, 16, 17, 18, 21, 22, 23)
WIDE = 8
LINE_BREAK, SPACES = 10, (30, 31)
CLASSES = ("text", "inline", "extended", "character", "malformed")
#: Bytes of texts laid side by side at a time; each unit takes about a hundred bytes while its text is scanned.
SLICE = 1 << 20

_EIGHT = np.zeros(1 << 16, bool)
_EIGHT[[*INLINE, *EXTENDED]] = True

TOKEN = T.StructType([T.StructField("kind", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("code", "start", "end", "visible_start", "visible_end")] + [T.StructField("text", T.StringType())])
FIELDS = [
    T.StructField("tokens", T.ArrayType(TOKEN)), T.StructField("visible", T.StringType()), T.StructField("to_visible", T.ArrayType(T.IntegerType())),
    T.StructField("payload_units", T.LongType()), T.StructField("malformed", T.LongType()),
]


def _controls(units: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where controls of eight units begin and end, texts side by side; one that its text cuts short takes what is left."""
    at = np.flatnonzero(_EIGHT[units])
    ends = np.minimum(at + WIDE, bounds[np.searchsorted(bounds, at, "right")]) if len(at) else at
    onward, chosen, k = np.searchsorted(at, ends).tolist(), [], 0
    while k < len(at):
        chosen.append(k)
        k = onward[k]
    return at[chosen], ends[chosen]


def scan(units: np.ndarray, bounds: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Tokens of texts laid side by side (bounds: where each begins, and the end), the map of places to visible places and what each unit shows.

    Places of a text count from its own beginning. The map has a place more than the text, so that the map of
    text t begins at bounds[t] + t.
    """
    n, sizes = len(units), np.diff(bounds)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    starts, ends = _controls(units, bounds)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    free = np.cumsum(edge[:-1]) == 0
    single, plain = free & (units < 32), free & (units >= 32)
    high, low = plain & (units >> 10 == 0x36), plain & (units >> 10 == 0x37)
    second = np.zeros(n, bool)
    second[1:] = high[:-1] & low[1:] & (text_of[1:] == text_of[:-1])
    shown = single & ((units == LINE_BREAK) | np.isin(units, SPACES))
    before = np.concatenate(([0], np.cumsum((plain & ~second) | shown)))
    base = before[bounds[:-1]]
    # a place between the halves of a pair is the pair's own
    places = np.arange(n + len(sizes)) - np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = np.append(second, False)[places] & (places < np.repeat(bounds[1:], sizes + 1))
    to_visible = before[places] - np.repeat(base, sizes + 1) - inside
    head = plain.copy()
    head[1:] &= ~(plain[:-1] & (text_of[1:] == text_of[:-1]))
    tail = plain.copy()
    tail[:-1] &= ~(plain[1:] & (text_of[1:] == text_of[:-1]))
    text_starts, text_ends, ones = np.flatnonzero(head), np.flatnonzero(tail) + 1, np.flatnonzero(single)
    codes = units[starts].astype(np.int64)
    kinds = np.where(ends - starts < WIDE, 4, np.where(np.isin(codes, INLINE), 1, 2))
    kind = np.concatenate((np.zeros(len(text_starts), np.int64), kinds, np.full(len(ones), 3)))
    first, last = np.concatenate((text_starts, starts, ones)), np.concatenate((text_ends, ends, ones + 1))
    order = np.argsort(first)
    first, last = first[order], last[order]
    owner = text_of[first] if len(first) else first
    token = {"owner": owner, "kind": kind[order], "code": np.concatenate((np.full(len(text_starts), -1), codes, units[ones].astype(np.int64)))[order], "first": first, "last": last}
    token |= {"visible_start": before[first] - base[owner], "visible_end": before[last] - base[owner]}
    show = np.where(plain, units, np.where(units == LINE_BREAK, LINE_BREAK, 32)).astype("<u2")
    return token, to_visible, np.where(plain | shown, show, 0).astype("<u2")


def tokenized(df: DataFrame, payload: str) -> DataFrame:
    """df with ``tokens``, ``visible`` text, ``to_visible``, ``payload_units`` and ``malformed`` of a binary column of little-endian units.

    A token is text, or a control with its code: inline or extended (eight units), character (one unit), or
    malformed where the text ends before its eight units do. Places are those of units, visible places those
    of characters; line breaks and the two spaces among the controls are visible, a half pair of surrogates takes a
    place but has no text, and text of such halves alone is no token. ``to_visible`` has a place more than the text.
    An odd last byte is ignored; a null payload has no units. Batches are cut to about a megabyte of payload.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *FIELDS])

    def work(batches):
        for batch in slices(batches, SLICE, payload):
            bodies = [b[: len(b) // 2 * 2] if b else b"" for b in batch.column(batch.schema.get_field_index(payload)).to_pylist()]
            units = np.frombuffer(b"".join(bodies), "<u2")
            bounds = np.concatenate(([0], np.cumsum([len(b) // 2 for b in bodies])))
            t, to_visible, show = scan(units, bounds)
            raw = units.tobytes()
            texts = [raw[2 * a : 2 * b].decode("utf-16-le", "ignore") if k == 0 else None for k, a, b in zip(t["kind"].tolist(), t["first"].tolist(), t["last"].tolist(), strict=True)]
            keep = np.array([x != "" for x in texts], bool)
            t, texts = {k: v[keep] for k, v in t.items()}, [x for x in texts if x != ""]
            rows, counts = len(bodies), np.bincount(t["owner"], minlength=len(bodies))
            base = bounds[:-1][t["owner"]]
            int32 = lambda x: pa.array(x.astype(np.int32))
            kinds = pa.array(np.array(CLASSES, object)[t["kind"]], pa.string())
            code = pa.array(t["code"].astype(np.int32), mask=t["kind"] == 0)
            items = pa.StructArray.from_arrays([kinds, code, int32(t["first"] - base), int32(t["last"] - base), int32(t["visible_start"]), int32(t["visible_end"]), pa.array(texts, pa.string())], [f.name for f in TOKEN.fields])
            lists = pa.ListArray.from_arrays(int32(np.concatenate(([0], np.cumsum(counts)))), items)
            visible = [show[a:b][show[a:b] > 0].tobytes().decode("utf-16-le", "ignore") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            wide, bad = np.isin(t["kind"], (1, 2)), t["kind"] == 4
            payloads = pa.array(np.bincount(t["owner"][wide], minlength=rows) * (WIDE - 1), pa.int64())
            maps = pa.ListArray.from_arrays(int32(bounds + np.arange(rows + 1)), int32(to_visible))
            new = [lists, pa.array(visible, pa.string()), maps, payloads, pa.array(np.bincount(t["owner"][bad], minlength=rows), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[f.name for f in FIELDS]])

    return df.mapInArrow(work, schema)
