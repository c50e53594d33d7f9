"""Removal of long repeated word spans over a compacted, minimiser-sampled de Bruijn graph.

Of every window of WINDOW words, the k-mer with the smallest hash is its anchor, so equal windows have
equal anchors and only a few of all k-mers are looked at. Anchors are the graph's nodes; an edge is the
token sequence from one anchor of a document to the end of its next one. Edges that several documents have
are repeated. Each repeated edge is kept once, with the coordinates of the first document that has it, and
nonbranching edges that follow each other there are compacted, by joins with the nodes' degrees, to a path.
A document's run along a path is known by two rows, where it enters and where it leaves the path, however
many edges lie between. A run goes on through a branch if it leaves a path at its end and enters, at its
beginning, the path that follows in the same first document. What such a run covers also stands in a smaller
document, as one span: these words go by their coordinates alone, without a row per window.

What is left to decide are windows that hold an anchor of several documents but do not lie within such a
run: those at a run's ends, and those of the first documents themselves. They are compared by a 96-bit hash
of all their words. Any other window was decided by a smaller document, so the smallest document that has a
window is always among those compared, and the result is that of comparing all windows. Edges meet by 128
bits of hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, forget, mix, ship, slices, word_hashes, written

WINDOW = 50
#: Words of an anchor. A window holds WINDOW - ANCHOR + 1 of them.
ANCHOR = 16
#: Bytes of text that are hashed at a time; each takes some thirty bytes of memory meanwhile.
SLICE = 1 << 19

_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(lane: int, inverse: bool, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a lane's base (odd, so it has an inverse modulo 2^64), kept for the next call."""
    have = _POWERS.get((lane, inverse))
    if have is None or len(have) < n:
        base = int(_BASE[lane])
        have = np.full(max(n, 1 << 16), np.uint64(pow(base, -1, 1 << 64) if inverse else base), np.uint64)
        have[0] = 1
        have = _POWERS[lane, inverse] = np.multiply.accumulate(have)
    return have[:n]


class Words:
    """Word hashes of many texts in a row, with prefix sums that give the hash of any span."""

    def __init__(self, h: np.ndarray, lane: int):
        self.lane = lane
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(lane, False, len(h)))))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans; equal spans have equal hashes wherever they stand."""
        inverse = _powers(self.lane, True, len(self.prefix))
        return mix((self.prefix[end] - self.prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (a numpy minimum or maximum) of all runs of w, from doubled runs."""
    size, out = 1, x
    while size * 2 <= w:
        out = best(out[: len(out) - size], out[size:])
        size *= 2
    n = len(x) - w + 1
    return best(out[:n], out[w - size : w - size + n])


def anchors(h: Words, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the k-mers that are the smallest (all of them on ties) of some window within a text."""
    n, w = int(bounds[-1]), window - k + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.arange(n - k + 1)
    kmer = h.spans(place, place + k)
    low = sliding(kmer, w, np.minimum)
    change = np.zeros(n + 2, np.int64)
    long = np.flatnonzero(np.diff(bounds) >= window)
    np.add.at(change, bounds[long], 1)
    np.add.at(change, bounds[long + 1] - window + 1, -1)
    low[np.cumsum(change)[: len(low)] == 0] = 0  # windows over the border of two texts
    none = np.zeros(w - 1, np.uint64)
    # a k-mer is the smallest of a window that covers it if it equals the largest minimum of those windows
    at = np.flatnonzero((kmer == sliding(np.concatenate((none, low, none)), w, np.maximum)) & (kmer > 0))
    return np.searchsorted(bounds, at, "right") - 1, at, kmer[at]


ANCHORS = "doc_id long, tkey int, i int, at int, anchor long, edge long"


def anchor_rows(base: DataFrame, window: int, k: int) -> DataFrame:
    """A row per anchor of (doc_id, tkey, text): its number and place in the text, its hash and that of the edge to the next one."""

    def apply(batches):
        for batch in slices(batches, SLICE):
            (h, g), bounds = word_hashes(batch.column(2), lower=False, lanes=2)
            text, at, hashes = anchors(Words(h, 0), bounds, window, k)
            if not len(at):
                continue
            first = np.searchsorted(text, text)
            follows = np.r_[text[1:] == text[:-1], False]
            edge = Words(g, 1).spans(at, np.where(follows, np.r_[at[1:], 0] + k, at))
            where = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(1).take(where), pa.array((np.arange(len(at)) - first).astype(np.int32)), pa.array((at - bounds[text]).astype(np.int32)),
                 pa.array(hashes.view(np.int64)), pa.array(edge.view(np.int64), mask=~follows)], names=[c.split()[0] for c in ANCHORS.split(", ")])

    return base.filter("doc_id is not null").mapInArrow(apply, ANCHORS)


def compacted(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchor, edge, first, start, offset, prior, then) of repeated edges, compacted to paths, and the table it was made of.

    places: doc_id, tkey, i, anchor, edge, to (the next anchor). ``first`` is the document (doc_id, tkey)
    that an edge is kept by, the smallest that has it. A path begins where the edge before it in that
    document is not repeated, is kept by another document, or leads into a node that has another repeated
    edge into or out of it. It is named by (first, start), the number of its first edge there; ``offset``
    is an edge's place on it, ``prior`` and ``then`` are its neighbours on it (null at its ends).
    """
    edges = places.groupBy("anchor", "edge").agg(F.min(F.struct("doc_id", "tkey", "i")).alias("x"), F.max("doc_id").alias("last"), F.first("to").alias("to"))
    edges = written(edges.filter("x.doc_id <> last").select("anchor", "edge", "to", F.struct("x.doc_id", "x.tkey").alias("first"), F.col("x.i").alias("pos")), "edges")
    out = edges.groupBy(F.col("anchor").alias("node")).count().filter("count = 1").select("node")
    into = edges.groupBy(F.col("to").alias("node")).count().filter("count = 1").select("node")
    plain = out.join(into, "node").select(F.col("node").alias("anchor"), F.lit(True).alias("plain"))
    along = Window.partitionBy("first").orderBy("pos")
    begins = ~(F.coalesce("plain", F.lit(False)) & (F.lag("pos").over(along) == F.col("pos") - 1))
    marked = edges.join(plain, "anchor", "left").withColumn("_begins", F.coalesce(begins, F.lit(True)))
    start = F.max(F.when(F.col("_begins"), F.col("pos"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    prior = F.when(~F.col("_begins"), F.lag("edge").over(along))
    then = F.when(~F.lead("_begins").over(along), F.lead("edge").over(along))
    paths = marked.select("anchor", "edge", "first", start.alias("start"), "pos", prior.alias("prior"), then.alias("then"))
    return written(paths.select("anchor", "edge", "first", "start", (F.col("pos") - F.col("start")).alias("offset"), "prior", "then"), "paths"), edges


def joined_runs(steps: list[dict]) -> list[tuple[int, int]]:
    """(number of the first edge, of the last one) of a document's runs, from where it enters and leaves paths, in order.

    A run goes on from one path to another only if it leaves the one at its end, enters the other at its
    beginning with its next edge, and the paths follow each other in the one document that both are kept
    by: then that document has the words of both as one span.
    """
    out: list[list] = []
    for s in steps:
        if s["enters"]:
            path = (s["first"], s["start"]) if s["offset"] == 0 else None
            if not (out and path and out[-1][1] == s["i"] - 1 and out[-1][2] == path):
                out.append([s["i"], s["i"], None])
        if s["leaves"]:
            out[-1][1:] = s["i"], (s["first"], s["start"] + s["offset"] + 1) if s["ended"] else None
    return [(a, b) for a, b, _ in out]


def decided(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc_id, tkey, cuts, spans) of texts that share an anchor with another document.

    cuts: begin and end of word spans that stand in a smaller document too, by the paths. spans: first and
    last start of the windows that are left to compare.
    """
    rows = written(anchor_rows(docs, window, k), "anchors")
    repeated = rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("anchor")
    repeated = written(repeated, "repeated")  # so that the join deals both sides itself and can split a hot anchor
    lists = rows.join(repeated, "anchor").groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set(F.struct("i", "at", "anchor", "edge"))).alias("x"))
    lists = written(lists, "anchor-lists")
    forget(rows, repeated)
    before, after = F.get("x", F.col("p") - 1), F.get("x", F.col("p") + 1)
    places = lists.select("doc_id", "tkey", "x", F.posexplode("x").alias("p", "y")).filter(after["i"] == F.col("y.i") + 1)
    places = places.select("doc_id", "tkey", "y.i", "y.anchor", "y.edge", after["anchor"].alias("to"), before["edge"].alias("came"), after["edge"].alias("goes"))
    paths, edges = compacted(places)
    # of a document's edges on a path, only those where it enters or leaves the path are kept
    steps = places.drop("to").join(paths, ["anchor", "edge"]).filter("doc_id > first.doc_id")
    steps = steps.withColumn("enters", ~F.coalesce(F.col("came") == F.col("prior"), F.lit(False))).withColumn("leaves", ~F.coalesce(F.col("goes") == F.col("then"), F.lit(False)))
    steps = steps.filter("enters or leaves").select("doc_id", "tkey", "i", "first", "start", "offset", "enters", "leaves", F.col("then").isNull().alias("ended"))
    steps = written(steps, "steps")
    forget(paths, edges)
    of_doc = steps.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_list(F.struct("i", "first", "start", "offset", "enters", "leaves", "ended"))).alias("steps"))
    reach = window - k

    def join_runs(batches):
        for batch in batches:
            cuts, spans = [], []
            for x, found in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                v = x.values
                i, at = v.field("i").to_numpy(), v.field("at").to_numpy().astype(np.int64)
                whole = joined_runs(found or [])
                begin = at[np.searchsorted(i, [r[0] for r in whole])] if whole else at[:0]
                end = at[np.searchsorted(i, [r[1] + 1 for r in whole])] + k if whole else at[:0]
                fit = end - begin >= window
                begin, end = begin[fit], end[fit]
                cuts.append(np.stack((begin, end), 1).ravel())
                # starts of windows that hold a shared anchor, less those of windows within a cut
                size = int(at[-1]) + 2
                change = np.zeros(size + 1, np.int64)
                np.add.at(change, np.maximum(at - reach, 0), 1)
                np.add.at(change, at + 1, -1)
                gone = np.zeros(size + 1, np.int64)
                np.add.at(gone, np.minimum(begin, size), 1)
                np.add.at(gone, np.minimum(end - window + 1, size), -1)
                left = np.r_[False, (np.cumsum(change)[:-1] > 0) & (np.cumsum(gone)[:-1] == 0), False]
                edge = np.flatnonzero(left[1:] != left[:-1])
                edge[1::2] -= 1
                spans.append(edge)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, kind), pa.array(spans, kind)], names=["doc_id", "tkey", "cuts", "spans"])

    out = written(lists.join(of_doc, ["doc_id", "tkey"], "left").mapInArrow(join_runs, "doc_id long, tkey int, cuts array<long>, spans array<long>"), "spans")
    forget(lists, steps)
    return out


def windows(marked: DataFrame, at: tuple[int, int, int, int], window: int) -> DataFrame:
    """(h0, x, doc_id, tkey): a row per window of ``marked`` that starts within a row's spans.

    at: places of doc_id, tkey, text and spans. h0 and the upper half of x are 96 bits of the window's
    hash; the lower half of x is where it starts.
    """
    low = np.int64(0xFFFFFFFF)
    names = ["doc_id", "tkey", "text", "spans"]

    def apply(batches):
        for some in slices(batches, SLICE):
            batch = pa.RecordBatch.from_arrays([some.column(c) for c in at], names=names).filter(some.column(at[3]).is_valid())
            if not batch.num_rows:
                continue
            (h, g), bounds = word_hashes(batch.column(2), lower=False, lanes=2)
            spans = batch.column(3)
            pairs = spans.flatten().to_numpy().reshape(-1, 2)
            row = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()) // 2)
            # a start too near to the end of its text has no window
            first, last = pairs[:, 0], np.minimum(pairs[:, 1], np.diff(bounds)[row] - window)
            n = np.maximum(last - first + 1, 0)
            start = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            row = np.repeat(row, n)
            if not len(start):
                continue
            s = start + bounds[row]
            x = Words(h, 0).spans(s, s + window).view(np.int64)
            y = Words(g, 1).spans(s, s + window).view(np.int64)
            where = pa.array(row)
            out = [pa.array(x), pa.array((y & ~low) | start), batch.column(0).take(where), batch.column(1).take(where)]
            yield from pa.Table.from_arrays(out, names=["h0", "x", "doc_id", "tkey"]).to_batches(max_chunksize=200_000)

    return marked.mapInArrow(apply, "h0 long, x long, doc_id long, tkey int")


def covered(starts: np.ndarray, cuts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``starts`` or within a cut."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n), -1)
    np.add.at(change, cuts[::2], 1)
    np.add.at(change, cuts[1::2], -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept_text.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller
    doc_id; all windows are judged on the input. Kept words are joined by one space; where nothing is
    removed, kept_text is the text itself. Null and empty texts have no words; very long ones are taken
    whole. Rows with a null doc_id are kept as they are and judge no other row. Rows that repeat a doc_id
    are judged each by its own text, and not against one another. Columns of docs named like those added
    are replaced. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    added = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    docs = docs.drop(*added).withColumn("_tkey", (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) - 2**31).cast("int"))
    found = decided(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_tkey").alias("tkey"), "text"), window, k)
    at = tuple(docs.columns.index(c) for c in ("doc_id", "_tkey", "text"))
    plan = found.toDF("_id", "_key", "_cuts", "_spans").hint("shuffle_hash")
    # both uses of the joined texts below are the same plan up to here, so texts are shuffled once
    on = (docs["doc_id"] == plan["_id"]) & (docs["_tkey"] == plan["_key"])
    marked = docs.join(plan, on, "left").drop("_id", "_key")
    seen = windows(marked, (*at, len(docs.columns) + 1), window)
    upper = F.shiftright("x", 32)
    least = seen.groupBy(F.col("h0").alias("k0"), upper.alias("k1")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi")
    starts = seen.join(least, (F.col("h0") == F.col("k0")) & (upper == F.col("k1")) & (F.col("doc_id") > F.col("lo")))
    starts = starts.groupBy(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).agg(F.collect_set(F.col("x").bitwiseAND(F.lit(0xFFFFFFFF))).alias("_starts"))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c for c in docs.columns if c != "_tkey"]

    def apply(batches):
        for batch in slices(batches, 2 << 20):
            out: list[list] = [[], [], [], []]
            texts, s, c = (batch.column(batch.schema.get_field_index(x)) for x in ("text", "_starts", "_cuts"))
            for text, start, cut in zip(texts.to_pylist(), s, c, strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
                n, gone = len(words), 0
                begin = start.values.to_numpy() if start.is_valid else np.zeros(0, np.int64)
                ends = cut.values.to_numpy() if cut.is_valid else np.zeros(0, np.int64)
                if len(begin) or len(ends):
                    drop = covered(begin, ends, n, window)
                    gone = int(drop.sum())
                    if gone:
                        words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                joined = b" ".join(words)
                for o, v in zip(out, (n, gone, hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if gone else text), strict=True):
                    o.append(v)
            kept = [batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(o, t) for o, t in zip(out, types, strict=True)]], names=[*names, *added])

    schema = docs.select(*names, F.lit(None).cast("long").alias(added[0]), F.lit(None).cast("long").alias(added[1]), F.lit(None).cast("string").alias(added[2]), F.lit(None).cast("string").alias(added[3])).schema
    starts = starts.hint("shuffle_hash")
    joined = marked.join(starts, (marked["doc_id"] == starts["_id"]) & (marked["_tkey"] == starts["_key"]), "left").select(*names, "_cuts", "_starts")
    out = joined.mapInArrow(apply, schema)
    out._strata_parts = [found]
    return out


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: All windows of all documents, compared word for word.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT s, min(doc_id) AS lo FROM x GROUP BY s HAVING min(doc_id) <> max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM x JOIN f USING (s) WHERE doc_id > lo),
d AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM g GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda v, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN d ON d.doc_id = w.doc_id
"""
