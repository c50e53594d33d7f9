"""Binary containers as rows: magic bytes, zip packages, XML elements, compound files, tagged records.

Each reader is one Arrow pass over (path, content) rows, without a shuffle. A file that cannot be read
gives one row whose ``status`` says why; it never fails the job. Guards are parameters and are checked
before anything is inflated.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.batches import slices
from strata.functions.shipping import ship

#: Rows and bytes of them that are sent together, of however many files.
MOST_ROWS, SLICE = 10000, 4 << 20
MOST_ENTRIES, MOST_BYTES, MOST_ENTRY_BYTES, MOST_STREAM_BYTES = 4096, 256 << 20, 32 << 20, 64 << 20
#: Marks at the start of a file (fixed values of the public formats).
MAGIC = {"zip": "504B0304", "compound": "D0CF11E0A1B11AE1", "pdf": "25504446", "png": "89504E470D0A1A0A", "gzip": "1F8B"}
_FREE, _END = 0xFFFFFFFF, 0xFFFFFFFE


def kind(content: Column) -> Column:
    """The container's kind by its first bytes, ``other`` where none is known, null without content."""
    head, out = F.hex(F.substring(content, 1, 8)), F.lit("other")
    for name, magic in MAGIC.items():
        out = F.when(head.startswith(magic), name).otherwise(out)
    return F.when(content.isNotNull(), out)


def _each(df: DataFrame, columns: list[str], make, schema: str, fields: list[pa.Field]) -> DataFrame:
    ship(df.sparkSession)
    names = [f.name for f in fields]

    def rows(got):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), fields, strict=True)], names=names)

    def apply(batches):
        got, size = [], 0
        for batch in slices(batches, SLICE, columns[-1]):
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for g in make(*row):
                    got.append(g)
                    size += sum(len(v) for v in g if isinstance(v, (bytes, str)))
                    if len(got) >= MOST_ROWS or size >= SLICE:
                        yield rows(got)
                        got, size = [], 0
        if got:
            yield rows(got)

    return df.select(*columns).mapInArrow(apply, schema)


def read_zip(content: bytes | None, entries: int, total: int, each: int) -> Iterator[tuple[str | None, int, str, bytes | None]]:
    try:
        z = zipfile.ZipFile(io.BytesIO(content or b""))
        infos = z.infolist()
    except (zipfile.BadZipFile, struct.error, ValueError, EOFError, NotImplementedError):
        yield None, 0, "not_a_zip", None
        return
    if len(infos) > entries or sum(i.file_size for i in infos) > total:
        yield None, 0, "too_large", None
        return
    seen = set()
    for i in infos:
        parts = i.filename.replace("\\", "/").split("/")
        status = "unsafe_name" if ".." in parts or parts[0] == "" or ":" in parts[0] else "duplicate" if i.filename in seen else "too_large" if i.file_size > each else "ok"
        seen.add(i.filename)
        body = None
        if status == "ok" and not i.is_dir():
            try:
                with z.open(i) as f:
                    body = f.read(each + 1)
                status = "too_large" if len(body) > each else status
            except (zipfile.BadZipFile, RuntimeError, zlib.error, EOFError, NotImplementedError):
                status, body = "damaged", None
        yield i.filename, i.file_size, status, body if status == "ok" else None


def zip_entries(files: DataFrame, entries: int = MOST_ENTRIES, total: int = MOST_BYTES, each: int = MOST_ENTRY_BYTES) -> DataFrame:
    """(path, entry, size, status, bytes) of every entry of zip packages."""
    fields = [pa.field("path", pa.string()), pa.field("entry", pa.string()), pa.field("size", pa.int64()), pa.field("status", pa.string()), pa.field("bytes", pa.binary())]
    return _each(files, ["path", "content"], lambda p, c: ((p, *e) for e in read_zip(c, entries, total, each)), "path string, entry string, size long, status string, bytes binary", fields)


def _elements(path, entry, data):
    """Elements in document order. Documents with a type declaration are refused, as entities could grow without bound."""
    bad = (path, entry, 0, None, 0, None, None, None)
    if data is None or b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        yield *bad, "refused"
        return
    try:
        root = ElementTree.fromstring(data)
    except (ElementTree.ParseError, ValueError, LookupError):
        yield *bad, "damaged"
        return
    local = lambda name: name.rsplit("}", 1)[-1]
    stack, pos = [(root, None, 0)], 0
    while stack:
        e, parent, depth = stack.pop()
        yield path, entry, pos, parent, depth, local(e.tag), {local(k): v for k, v in e.attrib.items()}, (e.text or "").strip(), "ok"
        stack.extend((c, pos, depth + 1) for c in reversed(e) if isinstance(c.tag, str))
        pos += 1


def xml_elements(entries: DataFrame) -> DataFrame:
    """(path, entry, pos, parent, depth, tag, attrs, text, status) of entries that end in .xml or .hpf."""
    text = [pa.field(n, pa.string()) for n in ("path", "entry")]
    rest = [pa.field("pos", pa.int32()), pa.field("parent", pa.int32()), pa.field("depth", pa.int32()), pa.field("tag", pa.string()), pa.field("attrs", pa.map_(pa.string(), pa.string())), pa.field("text", pa.string()), pa.field("status", pa.string())]
    schema = "path string, entry string, pos int, parent int, depth int, tag string, attrs map<string,string>, text string, status string"
    return _each(entries.filter(F.lower("entry").rlike(r"\.(xml|hpf)$") & (F.col("status") == "ok")), ["path", "entry", "bytes"], _elements, schema, text + rest)


def package_checks(entries: DataFrame, needed: list[str], mimetype: str | None = None) -> DataFrame:
    """(path, check, passed): needed parts, safe and single names, sizes, and the mimetype part's content."""
    has = lambda n: F.coalesce(F.bool_or((F.col("entry") == n) & (F.col("status") == "ok")), F.lit(False))
    no = lambda s: F.coalesce(F.bool_and(F.col("status") != s), F.lit(True))
    checks = {f"has:{n}": has(n) for n in needed} | {s: no(s) for s in ("not_a_zip", "unsafe_name", "duplicate", "too_large", "damaged")}
    if mimetype is not None:
        checks["mimetype"] = F.coalesce(F.bool_or((F.col("entry") == "mimetype") & (F.col("bytes") == F.lit(mimetype.encode()))), F.lit(False))
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), c.alias("passed")) for n, c in checks.items()])
    return entries.groupBy("path").agg(pairs.alias("_c")).select("path", F.inline("_c"))


def read_compound(content: bytes | None, most: int) -> Iterator[tuple[str | None, int, str, bytes | None]]:
    """Streams of a compound file by the published layout; every chain is checked for loops and bounds."""
    data = content or b""
    if len(data) < 512 or data[:8] != bytes.fromhex(MAGIC["compound"]):
        yield None, 0, "not_compound", None
        return
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    if shift not in (9, 12) or mini_shift != 6:
        yield None, 0, "bad_header", None
        return
    size, per = 1 << shift, (1 << shift) // 4
    (n_fat, first_dir), (cutoff, first_mini, _, first_difat, _) = struct.unpack_from("<II", data, 44), struct.unpack_from("<IIIII", data, 56)

    def sector(i: int) -> bytes:
        at = (i + 1) << shift
        if at >= len(data):
            raise ValueError("sector outside the file")
        return data[at : at + size]

    def chain(start: int, table: list[int]) -> Iterator[int]:
        seen = set()
        while start not in (_END, _FREE):
            if start in seen or start >= len(table):
                raise ValueError("broken chain")
            seen.add(start)
            yield start
            start = table[start]

    try:
        fat_at, at, seen = list(struct.unpack_from("<109I", data, 76)), first_difat, set()
        while at not in (_END, _FREE):
            if at in seen:
                raise ValueError("broken chain")
            seen.add(at)
            more = struct.unpack(f"<{per}I", sector(at))
            fat_at, at = fat_at + list(more[:-1]), more[-1]
        fat = [x for i in fat_at[:n_fat] if i not in (_END, _FREE) for x in struct.unpack(f"<{per}I", sector(i).ljust(size, b"\xff"))]
        entries = b"".join(sector(i) for i in chain(first_dir, fat))
        mini_fat = [x for i in chain(first_mini, fat) for x in struct.unpack(f"<{per}I", sector(i))]
        nodes = []
        for o in range(0, len(entries) - 127, 128):
            n, k, left, right, child = *struct.unpack_from("<HB", entries, o + 64), *struct.unpack_from("<III", entries, o + 68)
            start, length = struct.unpack_from("<IQ", entries, o + 116)
            nodes.append((entries[o : o + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace"), k, left, right, child, start, length & (0xFFFFFFFF if shift == 9 else (1 << 64) - 1)))
        mini = b"".join(sector(i) for i in chain(nodes[0][5], fat)) if nodes[0][6] else b""
    except (ValueError, struct.error, IndexError):
        yield None, 0, "damaged", None
        return
    stack, seen = [(nodes[0][4], "")], set()
    while stack:
        i, folder = stack.pop()
        if i == _FREE or i in seen or i >= len(nodes):
            continue
        seen.add(i)
        name, k, left, right, child, start, length = nodes[i]
        stack += [(right, folder), (left, folder)]
        if k == 1:
            stack.append((child, f"{folder}{name}/"))
        elif k == 2 and length > most:
            yield folder + name, length, "too_large", None
        elif k == 2:
            try:
                body = b"".join(mini[j << 6 : (j + 1) << 6] for j in chain(start, mini_fat)) if length < cutoff else b"".join(sector(j) for j in chain(start, fat))
                yield folder + name, length, "ok" if len(body) >= length else "truncated", body[:length]
            except ValueError:
                yield folder + name, length, "damaged", None


def compound_streams(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(path, stream, size, status, bytes) of every stream of compound files."""
    fields = [pa.field("path", pa.string()), pa.field("stream", pa.string()), pa.field("size", pa.int64()), pa.field("status", pa.string()), pa.field("bytes", pa.binary())]
    return _each(files, ["path", "content"], lambda p, c: ((p, *e) for e in read_compound(c, most)), "path string, stream string, size long, status string, bytes binary", fields)


def inflate(data: bytes, most: int = MOST_STREAM_BYTES) -> tuple[bytes, str]:
    """Raw deflate first, then zlib, else the bytes as they are; never more than ``most`` bytes."""
    for bits in (-15, 15):
        d = zlib.decompressobj(bits)
        try:
            out = d.decompress(data, most + 1)
        except zlib.error:
            continue
        if len(out) > most:
            return b"", "too_large"
        if d.eof:
            return out, "ok"
    return data, "stored"


def _records(path, stream, data, packed):
    body, status = inflate(data or b"") if packed else (data or b"", "ok")
    if status == "too_large":
        yield path, stream, 0, None, None, None, None, status
        return
    at, i = 0, 0
    while at < len(body):
        if at + 4 > len(body):
            yield path, stream, i, None, None, None, None, "truncated_header"
            return
        (head,) = struct.unpack_from("<I", body, at)
        tag, level, size, at = head & 0x3FF, head >> 10 & 0x3FF, head >> 20, at + 4
        if size == 0xFFF:
            if at + 4 > len(body):
                yield path, stream, i, tag, level, None, None, "truncated_size"
                return
            (size,) = struct.unpack_from("<I", body, at)
            at += 4
        part = body[at : at + size]
        yield path, stream, i, tag, level, size, part, "ok" if len(part) == size else "truncated_body"
        at, i = at + size, i + 1


def tagged_records(streams: DataFrame, packed: bool = True) -> DataFrame:
    """(path, stream, idx, tag, level, size, body, status): records with a 32-bit head of tag, level and size."""
    fields = [pa.field("path", pa.string()), pa.field("stream", pa.string()), pa.field("idx", pa.int32()), pa.field("tag", pa.int32()), pa.field("level", pa.int32()), pa.field("size", pa.int64()), pa.field("body", pa.binary()), pa.field("status", pa.string())]
    schema = "path string, stream string, idx int, tag int, level int, size long, body binary, status string"
    return _each(streams, ["path", "stream", "bytes"], lambda p, s, b: _records(p, s, b, packed), schema, fields)
