"""MinHash near-duplicates with banded candidates, odd sketches and exact confirmation.

A document's set holds its distinct word shingles. Documents with equal sets form one class, so copies
cost nothing beyond a partial aggregate. Each class has a MinHash signature, cut into bands, and an odd
sketch: every MinHash sample flips one bit of a small bitmap, so the XOR of two bitmaps has about as many
bits as the samples' symmetric difference, which tells high similarities precisely.

Candidates come in two rounds. First, every member of a band bucket meets the bucket's smallest member, a
number of pairs linear in the bucket. What these links leave apart, in buckets with more than two members,
meets in blocks of bounded size. Either round works in two steps: sketches alone tell which members of a
block have a candidate in another component, and only their full sets are brought to the block, where the
intersections are counted. Blocks are bounded by members and by the size of their sets. So no pair within a
group of copies is ever spelled out, and no link between different components is skipped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mix, ship, slices, small, window_hashes, word_hashes, written
from .components import components

SHINGLE = 5
#: Bands and rows: a pair at similarity 0.85 shares no band with probability 8e-7.
BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, as words of 64.
SKETCH_WORDS = 8
#: Classes, and shingles of theirs, that one block holds on average.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000

_RNG = np.random.default_rng(0x0DD)
_XOR = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_SALT = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples of sets of 64-bit hashes, none of them empty: a row per set."""
    out = np.empty((len(sets), SAMPLES), np.uint32)
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sets):  # so many sets at a time that their hashes stay in a core's cache
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + 60_000, "right")))
        x = (np.concatenate(sets[at:stop]) >> np.uint64(32)).astype(np.uint32)
        starts = ends[at:stop] - sizes[at:stop] - (ends[at] - sizes[at])
        y = np.empty_like(x)
        for i in range(SAMPLES):
            np.bitwise_xor(x, _XOR[i], out=y)
            np.multiply(y, _MUL[i], out=y)
            out[at:stop, i] = np.minimum.reduceat(y, starts)
        at = stop
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Per row of samples a bitmap in which each (place, value) sample flips one bit."""
    n, bits = len(samples), 64 * SKETCH_WORDS
    place = (mix(samples.astype(np.uint64) ^ _SALT) % np.uint64(bits)).astype(np.int64) + np.arange(n)[:, None] * bits
    odd = np.bincount(place.ravel(), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return key


def sketch_limit(threshold: float, sigmas: float = 4.5) -> int:
    """XOR bits that a pair at the threshold stays below, but for a deviation of so many sigmas."""
    n, differ = 64 * SKETCH_WORDS, SAMPLES * (1 - threshold)
    differ += sigmas * np.sqrt(SAMPLES * threshold * (1 - threshold))
    mean = n / 2 * (1 - (1 - 2 / n) ** (2 * differ))
    return int(np.ceil(mean + sigmas * np.sqrt(mean * (1 - 2 * mean / n) / 2)))


def document_sets(batch_text: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted; of fewer words, the whole sequence; of none, empty."""
    (h,), bounds = word_hashes(batch_text, lower=True)
    out = []
    for i in range(len(bounds) - 1):
        words = h[bounds[i] : bounds[i + 1]]
        if not len(words):
            out.append(np.zeros(0, np.uint64))
        else:
            k = min(shingle, len(words))
            out.append(np.unique(window_hashes(words, k) + np.uint64(k)))
    return out


SETS = "doc_id long, text_key long, n_shingles long, sig binary, bands array<long>, sketch array<long>"


def summaries(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, set size, digest of the set, band keys and odd sketch (null without words)."""

    def lists(some: np.ndarray, rows: np.ndarray) -> pa.Array:
        ends = np.r_[0, np.cumsum(some * rows.shape[1])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))

    def apply(batches):
        for batch in slices(batches, 1 << 20):
            sets = document_sets(batch.column(2), shingle)
            sizes = np.array([len(x) for x in sets], np.int64)
            some = sizes > 0
            samples = signatures([x for x in sets if len(x)])
            sigs = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            arrays = [batch.column(0), batch.column(1), pa.array(sizes), pa.array(sigs, pa.binary()), lists(some, band_keys(samples)), lists(some, odd_sketches(samples))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "n_shingles", "sig", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(apply, SETS)


def full_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, shingles) of rows (id, sig, text) whose text has the set of that digest."""

    def apply(batches):
        for batch in slices(batches, 1 << 20):
            found = [(i, x) for i, sig, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), document_sets(batch.column(2), shingle), strict=True) if hashlib.blake2b(x.tobytes(), digest_size=16).digest() == sig]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x.view(np.int64) for _, x in found], pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.mapInArrow(apply, "id long, shingles array<long>")


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j; many pairs at once by products of incidence matrices."""
    if len(i) < 200:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    used, place = np.unique(np.concatenate((i, j)), return_inverse=True)
    i, j = place[: len(i)], place[len(i) :]
    shingles, column, n = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    shared = np.cumsum(n > 1) - 1  # only shingles of two sets or more matter
    keep = n[column] > 1
    row, column, width = row[keep], shared[column[keep]], int((n > 1).sum())
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for start in range(0, width, 4096):
        lo, hi = np.searchsorted(column, (start, start + 4096))
        m = np.zeros((len(used), min(4096, width - start)), np.float32)
        m[row[lo:hi], column[lo:hi] - start] = 1
        total += m @ m.T
    return total[i, j].astype(np.int64)


_GROUP = ("k", "bi", "bj")
#: What a member is to its block: it meets those of the other side, or all others.
LEFT, RIGHT, BOTH = 0, 1, 2


def _blocks(batches):
    """Tables of the rows of one block each, from batches sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in _GROUP]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        if held:
            last = held[-1]
            change[0] = any(last.column(last.schema.get_field_index(c))[-1].as_py() != k[0] for c, k in zip(_GROUP, keys, strict=True))
        cuts = [0, *np.flatnonzero(change[1:]) + 1, batch.num_rows]
        for i in range(len(cuts) - 1):
            if held and (i or change[0]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(cuts[i], cuts[i + 1] - cuts[i]))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(rows: pa.Table, limit: int):
    """(x, y) places of pairs that may link: on different sides, of different components, with sketches alike."""
    comp, side = rows["component"].to_numpy(), rows["side"].to_numpy()
    sk = rows["sketch"].chunk(0).flatten().to_numpy().reshape(len(rows), SKETCH_WORDS).view(np.uint64)
    left, right = np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT)
    for s in range(0, len(left), 256):
        part = left[s : s + 256]
        d = np.zeros((len(part), len(right)), np.uint16)
        for w in range(SKETCH_WORDS):
            d += np.bitwise_count(sk[part, w][:, None] ^ sk[right, w][None, :])
        x, y = np.nonzero((d <= limit) & (comp[part][:, None] != comp[right][None, :]))
        x, y = part[x], right[y]
        apart = (side[x] != BOTH) | (x < y)
        yield x[apart], y[apart]


def block_links(members: DataFrame, sketches: DataFrame, sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """(a, b): components that a confirmed link between members of one block joins.

    members: k, bi, bj (the block), side, id, component. Members that have a candidate by sketch, at most
    ``limit`` bits apart, get their full sets; a block gives a spanning forest of what it joins, never the
    pairs.
    """
    names = [*_GROUP, "side", "id", "component", "sketch"]

    def sift(batches):
        for rows in _blocks(batches):
            hit = np.zeros(len(rows), bool)
            for x, y in _candidates(rows, limit):
                hit[x] = hit[y] = True
            if hit.any():
                yield from rows.filter(pa.array(hit)).to_batches()

    def compare(batches):
        for rows in _blocks(batches):
            comp, column, out = rows["component"].to_numpy(), rows["shingles"].chunk(0), []
            flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
            sets_of = [flat[ends[r] : ends[r + 1]] for r in range(len(rows))]
            size = ends[1:] - ends[:-1]
            root: dict[int, int] = {}

            def find(x, root=root):
                while (y := root.get(x, x)) != x:
                    root[x] = root.get(y, y)
                    x = y
                return x

            for x, y in _candidates(rows, limit):
                if not len(x):
                    continue
                both = intersections(sets_of, x, y)
                link = both * 100 >= percent * (size[x] + size[y] - both)
                for u, v in zip(comp[x[link]].tolist(), comp[y[link]].tolist(), strict=True):
                    p, q = find(u), find(v)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        out.append((u, v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    dealt = lambda df: df.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    some = members.join(sketches, "id").select(*names)
    some = written(dealt(some).mapInArrow(sift, "k long, bi int, bj int, side int, id long, component long, sketch array<long>"), "sifted")
    links = written(dealt(some.join(sets(some.select("id").distinct()), "id").select(*names, "shingles")).mapInArrow(compare, "a long, b long").distinct(), "links")
    forget(some)
    return links


def _parts(members: DataFrame, key: str) -> DataFrame:
    """(key, nb): into how many blocks the members of a key are dealt, by their number and the size of their sets."""
    by_size = F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
    return members.groupBy(key).agg(F.greatest(F.ceil(F.count("*") / BLOCK), by_size).cast("int").alias("nb"))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept and text_key (xxhash64 of the text).

    Documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id reachable by links, itself included, and kept marks that document. Texts that are
    null, empty or white space have no shingles and link with nothing; very long texts are taken whole.
    Rows that repeat a doc_id are judged each by its own text: of those in one component, the rows of the
    smallest text_key are kept. Rows with a null doc_id have no component and are kept. Other columns are
    ignored; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    base = written(summaries(docs, shingle), "minhash")
    usable = F.col("sig").isNotNull() & F.col("doc_id").isNotNull()
    classes = written(base.filter(usable).groupBy("sig").agg(F.min(F.struct("doc_id", "text_key")).alias("m"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    # a doc_id may stand for several sets, so classes have numbers of their own
    classes = classes.withColumn("doc_id", F.col("m.doc_id")).withColumn("id", F.xxhash64("sig"))
    banded = classes.select("id", "doc_id", "n_shingles", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min(F.struct("doc_id", "id")).alias("m"), F.count("*").alias("n")).filter("n > 1").select("key", "n", F.col("m.id").alias("least"))
    member = written(banded.drop("doc_id").join(buckets, "key"), "buckets")
    sketches = classes.select("id", "sketch")
    limit = sketch_limit(percent / 100)

    def sets(ids: DataFrame) -> DataFrame:
        """(id, shingles) of classes, from the text of the first document of each."""
        ids = written(ids, "wanted")
        of = ids.join(classes.select("id", "sig", F.col("doc_id").alias("_doc")), "id")
        of = small(written(of, "wanted-of"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
        found = full_sets(texts.join(of.select(F.col("_doc").alias("doc_id"), "id", "sig"), "doc_id").select("id", "sig", "text"), shingle)
        return found.groupBy("id").agg(F.first("shingles").alias("shingles"))

    # first round: stars around the smallest member of each bucket
    star = member.filter("id <> least").select(F.col("least").alias("k"), "id", "n_shingles").distinct()
    parts = written(_parts(star, "k"), "parts")
    leaves = star.join(parts, "k").select("k", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("bi"), F.lit(RIGHT).alias("side"), "id")
    centres = parts.select("k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bi"), F.lit(LEFT).alias("side"), F.col("k").alias("id"))
    stars = leaves.unionByName(centres).select("k", "bi", F.lit(0).alias("bj"), "side", "id", F.col("id").alias("component"))
    links = block_links(stars, sketches, sets, limit, percent)
    first = components(links)

    # second round: pairs with the smallest member are known; a bucket whose other members form one component has no more
    rest = member.filter("n > 2 and id <> least").join(first, "id", "left").select("key", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    mixed = rest.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n"), F.sum(F.col("id").cast("decimal(38,0)")).alias("s0"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("s1")).filter("c0 <> c1")
    mixed = mixed.groupBy("n", "s0", "s1").agg(F.min("key").alias("key")).select("key")  # of buckets with equal members, one
    rest = written(rest.join(mixed, "key"), "rest")
    forget(member, parts, links)
    nb = written(_parts(rest, "key"), "parts")
    m = rest.join(small(nb), "key").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    side = F.when(F.col("mine") == F.col("other"), BOTH).when(F.col("mine") < F.col("other"), LEFT).otherwise(RIGHT)
    m = m.select(F.col("key").alias("k"), F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), side.alias("side"), "id", "component")
    more = block_links(m, sketches, sets, limit, percent)
    second = components(more)
    forget(rest, more, nb)

    named = classes.select("sig", "id", "m").join(first, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    named = named.join(second.toDF("c", "component"), "c", "left").withColumn("c", F.coalesce("component", "c"))
    least = named.groupBy("c").agg(F.min("m").alias("l"), F.count("*").alias("n")).filter("n > 1").drop("n")
    named = named.join(least, "c", "left").select("sig", F.coalesce("l", "m").alias("l"))
    out = base.filter(usable).join(named, "sig").select("doc_id", "n_shingles", F.col("l.doc_id").alias("component_id"), (F.struct("doc_id", "text_key") == F.col("l")).alias("kept"), "text_key")
    alone = base.filter(~usable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_key")
    out = out.unionByName(alone)
    out._strata_parts = [base, classes, first, second]
    return out


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, percent=85).drop("text_key")


#: Links between all documents that share a shingle, and what can be reached by them.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
