"""WARC archives of captured pages and globally ordered capture histories.

Each WARC/1.1 record is a gzip member of its own, so that a reader can seek to any record by the offset in
the index. Spark's own writer puts the members together: any Hadoop file system will do, and a lost
executor's files are written again by the commit protocol. Archives are bounded by records and by bytes and
are read member by member. Of equal payloads the first page's record is a response, the others are revisits of it.
Archives are parsed by the lengths in their headers. Each archive gives one locally sorted run of index
lines; the runs are cut at common key ranges and each range is merged by a k-way loser tree, so that the
index is ordered by URL key and timestamp across all files.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, new_path, ship, written

#: Records in an archive at most, and bytes of payload in it at most (or one record).
RECORDS, ARCHIVE_BYTES = 1_000, 512 << 20
#: Bytes of a record in one gzip member at most: a member's length field then ends in a zero byte.
MEMBER_BYTES = (1 << 24) - 1
#: Index lines in one merged range, on average.
RANGE = 100_000
#: Capture time of page 0 where the pages bring no time; page n is taken n seconds later, modulo TURN.
BEGIN = datetime(2024, 1, 1, tzinfo=UTC)
TURN = 100_000_000
#: The alphabet of RFC 4648 (a fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(body: Column) -> Column:
    """SHA-1 of bytes in upper-case base 32, from five hexadecimal digits to four characters at a time."""
    out = []
    for g in range(8):
        x = F.conv(F.substring(F.sha1(body), 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(x, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def record_id(page: Column) -> Column:
    """A name made of the page_id; rows that repeat a page_id are told apart by archive and offset."""
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html, captured) with bytes, digest and first (the page that a revisit refers to).

    Payloads of fewer bytes than ``least_bytes`` are never revisits.
    """
    body = F.coalesce("html", F.lit(""))
    p = pages.withColumn("html", body).withColumn("digest", base32_sha1(body.cast("binary"))).withColumn("bytes", F.octet_length(body).cast("long"))
    firsts = p.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return p.join(firsts, "digest", "left").withColumn("first", F.when(F.col("first") != F.col("page_id"), F.col("first")))


def records(typed: DataFrame) -> DataFrame:
    """One column, value: the text of each record, without the last line end."""
    end = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    # control characters and blanks would break the header line
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return typed.select(F.concat(F.concat_ws("\r\n", *lines), end, end, block, end, end).cast("binary").alias("value"))


def members(texts: DataFrame) -> DataFrame:
    """(value): each record's gzip members, less the last byte.

    That byte is the highest of the member's length and always zero, so the text writer's line end, set to
    one zero byte, completes each record and the file is plain gzip members one after another.
    """

    def apply(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                out = []
                for x in batch.column(0).slice(s, 200):
                    body = x.as_py()
                    out.append(b"".join(zlib.compress(body[i : i + MEMBER_BYTES], 6, 31) for i in range(0, len(body), MEMBER_BYTES))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return texts.mapInArrow(apply, "value binary").select(F.col("value").cast("string"))


def write_archives(pages: DataFrame, path: str, captured: str | None = None, least_bytes: int = 0) -> None:
    """Writes a record per row of pages (page_id, url, html) to archives of gzip members below ``path``.

    Very large pages are written whole. A null html is an empty payload, a null url about:blank. Rows that repeat the smallest page_id of a
    payload are all responses. captured names a timestamp column, if there is one.
    """
    when = F.col(captured) if captured else F.timestamp_seconds(F.lit(int(BEGIN.timestamp())) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(TURN)))
    p = pages.select(F.col("page_id").cast("long"), "url", "html", when.alias("captured"))
    typed = with_types(p, least_bytes)
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    most = p.agg(F.max(size)).collect()[0][0] or 0
    fair = ARCHIVE_BYTES // RECORDS
    # pages larger than an archive's share get archives of fewer records
    for part, n in ((typed, RECORDS),) if most <= fair else ((typed.filter(F.col("bytes") <= fair), RECORDS), (typed.filter(F.col("bytes") > fair), max(1, ARCHIVE_BYTES // most))):
        members(records(part)).write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", n).text(path)


def unpacked(content: bytes):
    """(offset, bytes) of each gzip member; bytes that are no gzip are one member."""
    if content[:2] != b"\x1f\x8b":
        yield 0, content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        d, parts, stop, step = zlib.decompressobj(31), [], at, 4096
        while not d.eof and stop < len(view):
            parts.append(d.decompress(view[stop : stop + step]))
            stop, step = min(len(view), stop + step), 1 << 16
        if not d.eof:
            raise ValueError(f"gzip member at {at} has no end")
        yield at, b"".join(parts)
        at = stop - len(d.unused_data)


def parse(content: bytes):
    """(offset, headers, block) of each record of an archive; offsets are those of the record's first gzip member.

    A record may take several members, and a member may hold several records, which then share its offset.
    """
    data, at, begin = b"", 0, 0
    parts = unpacked(content)
    while True:
        if at >= len(data):
            found = next(parts, None)
            if found is None:
                return
            (begin, data), at = found, 0
            if not data:
                continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at {begin}")
        while (stop := data.find(b"\r\n\r\n", at)) < 0:
            data += next(parts)[1]
        headers = {}
        for line in data[at:stop].decode("utf-8").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.lower()] = value.strip()
        end = stop + 4 + int(headers["content-length"])
        if len(data) < end + 4:  # the rest of a long record is in the next members
            more = [data]
            size = len(data)
            while size < end + 4:
                more.append(next(parts)[1])
                size += len(more[-1])
            data = b"".join(more)
        yield begin, headers, data[stop + 4 : end]
        at = end + 4


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then path and query, lower case, without scheme and fragment."""
    try:
        u = urlsplit(url)
        host, port = u.hostname or "", u.port
    except ValueError:
        return url.lower()
    name = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    return f"{name}{f':{port}' if port and port not in (80, 443) else ''}){(u.path or '/').lower()}" + (f"?{u.query.lower()}" if u.query else "")


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, the root's winner goes out."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * self.k
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            held = self.tree[node]
            if held < 0:  # the first one here waits for its opponent
                self.tree[node] = winner
                return
            if self._less(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        if not self.runs:
            return
        while True:
            w = self.tree[0]
            if self.at[w] >= len(self.runs[w]):
                return
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._play(w)


INDEX = "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, record_offset long"
_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_PAGE = re.compile(r"<urn:x-page:(-?\d+)>")


def _order(r: tuple) -> tuple:
    return r[0], r[1], r[2] is not None, r[2] or 0, r[7], r[8]


def _page(text: str | None) -> int | None:
    m = _PAGE.fullmatch(text or "")
    return int(m[1]) if m else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One locally sorted run of index lines per archive. Digests and sizes of payloads that are there are checked."""
    import base64
    import hashlib

    def apply(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                run, rows = name.rsplit("/", 1)[-1], []
                for offset, h, block in parse(content.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    n = int(re.search(rb"(?im)^content-length: (\d+)", head)[1])
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"damaged record at {offset} of {name}")
                    stamp = re.sub(r"\D", "", h["warc-date"])
                    rows.append((url_key(h["warc-target-uri"]), stamp, _page(h["warc-record-id"]), n, digest, h["warc-type"], _page(h.get("warc-refers-to")), run, offset))
                rows.sort(key=_order)
                yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(apply, INDEX)


def merge_runs(runs: DataFrame, lines: int) -> DataFrame:
    """Runs merged into key ranges; partitions follow one another in order of URL key, time and page."""

    def apply(batches):
        own: dict[str, list] = defaultdict(list)
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own[r[7]].append((_order(r), r))
        for part in own.values():  # slices of sorted runs; a shuffle may bring them in pieces
            if any(a[0] > b[0] for a, b in zip(part, part[1:], strict=False)):
                part.sort(key=lambda x: x[0])
        held = []
        for _, r in LoserTree([own[k] for k in sorted(own)]):
            held.append(r)
            if len(held) == 10_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    n = max(1, -(-lines // RANGE))
    return runs.repartitionByRange(n, "urlkey", "captured", "page_id", "run").mapInArrow(apply, INDEX)


def archive_index(pages: DataFrame, captured: str | None = None, least_bytes: int = 0, keep: str | None = None) -> DataFrame:
    """Writes the archives (to ``keep``, else a temporary shared folder), reads them back and merges their index.

    Extra columns are ignored; an empty table gives an empty index. Rows that repeat are captured one by
    one, also when they repeat a page_id. Rows with a null page_id have a null page_id and never are the page a
    revisit refers to.
    """
    spark = pages.sparkSession
    ship(spark)
    path = keep or new_path(spark, "warc")
    write_archives(pages, path, captured, least_bytes)
    runs = written(read_runs(spark, path), "warc-runs")
    if not keep:
        holder = spark.createDataFrame([], "x int")
        holder._strata_path = path
        forget(holder)
    return merge_runs(runs, runs.count())


def query(pages: DataFrame) -> DataFrame:
    return archive_index(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHARS = " || ".join(f"substr('{BASE32}', ((x{g} >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
x AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, h, {", ".join(f"('0x' || substr(h, {5 * g + 1}, 5))::INTEGER AS x{g}" for g in range(8))} FROM p),
d AS (SELECT page_id, payload_bytes, {_CHARS} AS payload_digest FROM x),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""
