"""HTML pages as ordered blocks, and their text by a parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from strata.functions.shipping import ship

_KINDS = {"p": "paragraph", "li": "list_item", "td": "cell", "th": "cell", "figcaption": "caption"} | {f"h{i}": "heading" for i in range(1, 7)}
_HIDDEN = ("script", "style")


class _Blocks(HTMLParser):
    def __init__(self, hidden: bool):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.depth, self.open, self.hidden = [], [], 0, None, hidden

    def _close(self):
        if self.open:
            kind, level, parts = self.open
            if words := " ".join("".join(parts).split()):
                self.blocks.append((kind, level, words))
        self.open = None

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.depth += 1
        elif tag in _KINDS:
            self._close()
            self.open = (_KINDS[tag], int(tag[1]) if re.fullmatch(r"h[1-6]", tag) else 0, [])
        elif tag == "img":
            self.blocks.append(("image", 0, dict(attrs).get("alt") or ""))
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.depth = max(0, self.depth - 1)
        elif tag in _KINDS:
            self._close()

    def handle_data(self, data):
        if self.depth and not self.hidden:
            return
        self.text.append(data)
        if self.open and not self.depth:
            self.open[2].append(data)


def parse(html: str | None, hidden: bool = False) -> tuple[list[tuple[str, int, str]], str]:
    """(blocks, text) of a page; ``hidden`` keeps the data of scripts and styles in the text."""
    p = _Blocks(hidden)
    p.feed(html or "")
    p.close()
    p._close()
    return p.blocks, " ".join(" ".join(p.text).split())


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, kind, level, text): headings, paragraphs, list items, cells, captions and images in order; empty ones but images are left out."""
    ship(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def apply(batches):
        for b in batches:
            rows = [(k, i, *x) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, x in enumerate(parse(h)[0])]
            types = [b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[key, "pos", "kind", "level", "text"])

    return pages.select(key, html).mapInArrow(apply, f"{key} {kind}, pos int, kind string, level int, text string")


def html_parsed(pages: DataFrame, hidden: bool = False, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, body): text by the parser, entities decoded, white space collapsed."""
    ship(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def apply(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(h, hidden)[1] for h in b.column(1).to_pylist()], pa.string())], names=[key, "body"])

    return pages.select(key, html).mapInArrow(apply, f"{key} {kind}, body string")
