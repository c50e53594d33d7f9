"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for every i, the polynomial hash of its first i code points modulo a prime.
Two lookups give the hash of any span, so span equality takes constant time and the longest common
extension of two places is found by binary search. A fingerprint is the length, the hash of the whole
text and a bottom-k sketch over the hashes of all spans of fixed length (shorter at the beginning); the likeness of two
fingerprints is the sketches' estimate of the share of spans they have in common.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ship

#: Moduli below 2^31 (products fit 64 bits) and bases of the two hash lanes.
MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Code points of a sketched span; spans kept in a sketch.
SPAN = 12
SKETCH = 64
#: Bytes of text that one bucket of neighbouring documents holds, on average, and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 100_000
#: Rows looked at for each border between buckets.
SAMPLED = 20

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(tables: list[np.ndarray], lane: int, base: int, n: int) -> np.ndarray:
    """The lane's powers 0 to n - 1, doubled until they reach that far."""
    t, p = tables[lane], np.uint64(MODULI[lane])
    while len(t) < n:
        t = np.concatenate((t, t * np.uint64(pow(base, len(t), MODULI[lane])) % p))
    tables[lane] = t
    return t[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefix:
    """Prefix polynomial hashes of one text, in two lanes."""

    def __init__(self, points: np.ndarray, lanes: int = 2):
        self.n = len(points)
        self.sums = []
        for k in range(lanes):
            p = np.uint64(MODULI[k])
            terms = (points.astype(np.uint64) + np.uint64(1)) * _grow(_POWERS, k, BASES[k], self.n) % p
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms) % p)))

    def spans(self, length: int, lane: int = 0) -> np.ndarray:
        """Hashes of all spans of one length; equal spans have equal hashes wherever they stand."""
        n = self.n - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        p, s = np.uint64(MODULI[lane]), self.sums[lane]
        inverse = _grow(_INVERSE, lane, pow(BASES[lane], -1, MODULI[lane]), n)
        return (s[length:] + p - s[:-length]) % p * inverse % p

    def span(self, start: int, length: int) -> tuple[int, ...]:
        out = []
        for k, s in enumerate(self.sums):
            p = MODULI[k]
            inverse = _grow(_INVERSE, k, pow(BASES[k], -1, p), start + 1)
            out.append((int(s[start + length]) - int(s[start])) % p * int(inverse[start]) % p)
        return tuple(out)


def equal_spans(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    """Whether two spans are equal; spans beyond either end are not."""
    return i + length <= a.n and j + length <= b.n and a.span(i, length) == b.span(j, length)


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest common extension from i and j, by binary search over span hashes."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, middle) == b.span(j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def sketch(prefix: Prefix) -> np.ndarray:
    """The SKETCH smallest distinct mixed span hashes, ascending.

    A span ends at each code point: it is the SPAN last ones up to there, or all of them where they are
    fewer. So the rule is one for all lengths, and a text of n code points has n spans.
    """
    if not prefix.n:
        return np.zeros(0, np.uint64)
    head = slice(1, min(SPAN, prefix.n + 1))
    lanes = [np.concatenate((prefix.sums[k][head], prefix.spans(SPAN, k))) for k in (0, 1)]
    h = mix((lanes[0] << np.uint64(31)) ^ lanes[1])
    if len(h) > 8 * SKETCH:  # the smallest few are nearly always enough
        few = np.unique(h[h < np.uint64(2**64 * (4 * SKETCH / len(h)))])
        if len(few) >= SKETCH:
            return few[:SKETCH]
    return np.unique(h)[:SKETCH]


def fingerprint(prefix: Prefix) -> tuple[str, np.ndarray]:
    whole = prefix.span(0, prefix.n)
    s = sketch(prefix)
    return f"{prefix.n:x}:{whole[0]:08x}{whole[1]:08x}:{s.astype('>u8').tobytes().hex()}", s


def read(text: str) -> tuple[str, np.ndarray]:
    """The part of a fingerprint that stands for the whole text, and its sketch."""
    head, _, body = text.rpartition(":")
    return head, np.frombuffer(bytes.fromhex(body), ">u8").astype(np.uint64)


def sketch_likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Twice the common distinct spans by the sum of both counts (Dice), from the bottom-k Jaccard estimate."""
    union = np.union1d(x, y)[:SKETCH]
    if not len(union):
        return 0.0
    jaccard = float(np.isin(union, np.intersect1d(x, y, assume_unique=True), assume_unique=True).mean())
    return 2 * jaccard / (1 + jaccard)


def likeness(a: str, b: str) -> float:
    """From 0 to 1: 1 for fingerprints of equal texts, else the estimated share of common spans."""
    (h, x), (g, y) = read(a), read(b)
    return 1.0 if h == g else sketch_likeness(x, y)


def edited(text: str, following: str) -> str:
    """The text whose last third is replaced by the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def cuts_of(ids: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders (id, hash) of n buckets of about equal size, from about SAMPLED rows a bucket, taken by hash."""
    rows = ids.count()
    share = min(1.0, SAMPLED * n / max(rows, 1))
    some = ids.filter(F.pmod(F.xxhash64("_id", "_h"), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).toArrow()
    i, h = some["_id"].to_numpy(), some["_h"].to_numpy()
    order = np.lexsort((h, i))
    at = order[np.linspace(0, len(order), n + 1).astype(int)[1:-1]] if len(order) >= n else order
    return i[at], h[at]


def bucket_of(i: np.ndarray, h: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the borders are at or below each (id, hash), by binary search."""
    out, stop = np.searchsorted(cuts[0], i, "left"), np.searchsorted(cuts[0], i, "right")
    for x in np.unique(i[out < stop]):  # ids on a border: their hashes decide
        mine = i == x
        lo, hi = np.searchsorted(cuts[0], x, "left"), np.searchsorted(cuts[0], x, "right")
        out[mine] = lo + np.searchsorted(cuts[1][lo:hi], h[mine], "right")
    return out


def neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, _id, _h, _bucket, _ghost) and the number of buckets: documents next to each other in order.

    The order is that of descending _id (the doc_id; nulls count as smaller than any) and of _h, a hash of
    the text. A bucket holds about BUCKET_BYTES of text, or more where that would make more than
    MOST_BUCKETS. As a ghost, it also gets the row that follows its last one, the first row of the bucket
    after it (the last one: of the first). So a bucket is a task of its own, and what the driver and a
    broadcast hold is bounded by MOST_BUCKETS, whatever the data.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", key.alias("_id"), F.xxhash64("text").alias("_h"))
    total = d.select(F.sum(F.octet_length("text")).alias("b")).collect()[0]["b"] or 0
    n = min(MOST_BUCKETS, int(total // BUCKET_BYTES) + 1)
    shared = spark.sparkContext.broadcast(cuts_of(d.select("_id", "_h"), n) if n > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64)))

    def deal(batches):
        for batch in batches:
            i, h = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_id", "_h"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket_of(i, h, shared.value).astype(np.int32))], names=[*batch.schema.names, "_bucket"])

    heads = d.select("_id", "_h").mapInArrow(deal, "_id long, _h long, _bucket int")
    heads = heads.groupBy("_bucket").agg(F.min(F.struct(F.bitwise_not("_id").alias("down"), "_h")).alias("x")).orderBy(F.desc("_bucket")).collect()  # a row per bucket
    d = d.mapInArrow(deal, "doc_id long, text string, _id long, _h long, _bucket int")
    if not heads:
        return d.withColumn("_ghost", F.lit(False)), 1
    rows = [(~r["x"]["down"], r["x"]["_h"], heads[k - 1]["_bucket"]) for k, r in enumerate(heads)]
    ghosts = F.broadcast(spark.createDataFrame(rows, "_id long, _h long, _to int"))
    first = d.drop("_bucket").join(ghosts, ["_id", "_h"]).groupBy("_to").agg(F.min(F.struct("text", "doc_id", "_id", "_h")).alias("x"))
    first = first.select("x.doc_id", "x.text", "x._id", "x._h", F.col("_to").alias("_bucket"), F.lit(True).alias("_ghost"))
    return d.withColumn("_ghost", F.lit(False)).unionByName(first), n


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses and the common prefix.

    Null texts are empty. The next document is the one after it in descending order of doc_id; after
    the last comes the first, so a single document follows itself. Rows that repeat a doc_id follow
    each other in the order of a hash of their texts. Very long texts are taken whole. An empty table gives
    an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    near, n = neighbours(docs)
    dealt = near.repartitionById(n, "_bucket").sortWithinPartitions(F.desc("_bucket"), "_ghost", F.desc("_id"), "_h", "text").select("doc_id", "text", "_bucket", "_ghost")

    def apply(batches):
        before = None  # (doc_id, text, bucket, prefix, fingerprint, sketch) of a row that waits for its next one
        for batch in batches:
            out = []
            for doc, text, bucket, ghost in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                p = Prefix(code_points(text))
                f, s = fingerprint(p)
                if before is not None and before[2] == bucket:
                    out.append(row(before, text, p, f, s))
                before = None if ghost else (doc, text, bucket, p, f, s)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def row(x, following, q, g, t):
        doc, text, _, p, f, s = x
        e = edited(text, following)
        if e == text:
            pe, fe, se = p, f, s
        else:
            pe = Prefix(code_points(e))
            fe, se = fingerprint(pe)
        same = sketch_likeness(s, se) if f != fe else 1.0
        return doc, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f, fe, same, 1.0 if f == g else sketch_likeness(s, t), common_extension(p, 0, pe, 0)

    return dealt.mapInArrow(apply, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
