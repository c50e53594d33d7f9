"""Periodic runs of words, found by naming blocks of power-of-two lengths.

Words of a document get numbers. Where a run of period p has at least four periods, words p apart agree over
3p places or more, so a grid of that step meets every run. A grid place whose words agree is extended both
ways: Karp, Miller and Rosenberg's names tell in one comparison whether two blocks of 2^k words are equal,
and descending the levels gives the longest common extension. Nothing is hashed and no suffixes are sorted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, id_crc, ship, slices

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Levels of names at most; longer blocks are compared by repeated steps of the greatest one.
LEVELS = 16
#: Grid places that are looked at together.
PLACES = 1 << 21

FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Names:
    """Names of all blocks of 2^k places: equal names at one level mean equal blocks."""

    def __init__(self, x: np.ndarray, longest: int):
        level = np.unique(x, return_inverse=True)[1].astype(np.int32)
        self.levels, width = [level], 1
        while len(self.levels) < LEVELS and 2 * width <= min(longest, len(x)):
            pair = level[:-width].astype(np.int64) * (int(level.max()) + 1) + level[width:]
            known, level = np.unique(pair, return_inverse=True)
            level = level.astype(np.int32)
            self.levels.append(level)
            width *= 2
            if len(known) == len(pair):  # no two blocks are equal, nor are longer ones
                break

    def extension(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many places from i and from j on agree; with ``back``, how many before them do."""
        size = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[k], 1 << k
            active = np.arange(len(i))
            while len(active):
                a, b = (i[active] - size[active] - width, j[active] - size[active] - width) if back else (i[active] + size[active], j[active] + size[active])
                fits = (a >= 0) & (np.maximum(a, b) < len(names))
                active, a, b = active[fits], a[fits], b[fits]
                active = active[names[a] == names[b]]
                size[active] += width
                if k < len(self.levels) - 1:  # a lower level fits once at most
                    break
        return size


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the counts' units, its group and its number within it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def _grid(x: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
    """Grid places (document, place in x, period) whose words agree over three places at least on one side."""
    doc, period = _expand(sizes // LEAST_EXPONENT)
    period += 1
    # words p apart agree over so many consecutive places in any run of period p
    step = np.maximum((LEAST_EXPONENT - 1) * period, LEAST_LENGTH - period)
    counts = -(-(sizes[doc] - period) // step)
    ends = np.cumsum(counts)
    at = 0
    while at < len(doc):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, "right")))
        group, k = _expand(counts[at:stop])
        d, p = doc[at:stop][group], period[at:stop][group]
        i = begins[d] + k * step[at:stop][group]
        same = lambda i, p, t: x[i + t] == x[i + p + t]
        keep = same(i, p, 0)
        d, p, i = d[keep], p[keep], i[keep]
        keep = (same(i, p, 1) & same(i, p, 2)) | (same(i, p, -1) & same(i, p, -2) & same(i, p, -3))
        yield d[keep], i[keep], p[keep]
        at = stop


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of word numbers, its runs as rows (start, length, period), by start and then period.

    A run is a maximal stretch with smallest period q and at least max(6, 4 q) words.
    """
    found = [np.zeros((0, 3), np.int64) for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)

    def laid(which):
        """The sequences one after another, after each a number that is nowhere else; three such numbers at both ends."""
        borders = -1 - np.arange(len(which) + 6)
        parts = [borders[:3]]
        for k, d in enumerate(which):
            parts += [texts[d], borders[6 + k : 7 + k]]
        begins = 3 + np.concatenate(([0], np.cumsum(sizes[which] + 1)))[:-1]
        return np.concatenate([*parts, borders[3:6]]), begins

    every = np.flatnonzero(sizes >= LEAST_LENGTH)
    if not len(every):
        return found
    x, begins = laid(every)
    places = list(_grid(x, begins, sizes[every]))
    doc, at, period = (np.concatenate(c) for c in zip(*places, strict=True))
    if not len(doc):
        return found
    some, own = np.unique(doc, return_inverse=True)
    y, starts = laid(every[some])
    i = at - begins[doc] + starts[own]
    names = Names(y, int(sizes[every[some]].max()))
    j = i + period
    start = i - names.extension(i, j, back=True)
    length = j + names.extension(i, j) - start
    keep = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
    rows = np.stack((own, start - starts[own], length, period), 1)[keep]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch that has a period also has its multiples: the smallest one is its own
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    for d, part in zip(some, np.split(rows[:, 1:], np.searchsorted(rows[:, 0], np.arange(1, len(some)))), strict=True):
        found[every[d]] = part
    return found


def kept_places(n: int, runs: np.ndarray) -> np.ndarray:
    """Places of n words that stay when each run keeps its first period only."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(cover[:-1]) == 0)


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document: its runs by start and then period, and its text without their repeats.

    A word stays unless some run contains it after that run's first period; words are joined by one space.
    Null, empty and blank texts have no words and no runs. Texts are taken whole, however long: a worker
    holds a number for each word and level of the texts of one slice, or of one long text. Rows that
    repeat a doc_id are judged alike, a null doc_id stays null; other columns are ignored; an empty table
    gives an empty one. Runs that overlap, or lie within a longer one with another period, all count.
    """
    ship(docs.sparkSession)

    def work(batches):
        for batch in slices(batches, 2 << 20):
            words = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            number: dict[bytes, int] = {}
            texts = [np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in words]
            runs = runs_of(texts)
            text = [b" ".join(ws) if not len(r) else b" ".join([ws[k] for k in kept_places(len(ws), r).tolist()]) for ws, r in zip(words, runs, strict=True)]
            rows = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(text, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, FOUND)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents whose crc32 is divisible by ten go on from some word in a repeated stretch of themselves.

    With g a tenth of that number and n words, word i >= a becomes word a + (i - a) mod p, where a = g mod n
    and p = 1 + (n - a) div (3 + g mod 8). Other texts, and those without words, stay as they are.
    """
    h = id_crc("doc_id", 1 << 32)
    g = F.floor(h / 10)
    words = F.array(F.regexp_extract_all("text", F.lit(WORD), 0))  # bound once by the function below

    def turned(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")

    text = F.when((h % 10 == 0) & F.col("text").rlike(WORD), F.transform(words, turned)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def query(documents: DataFrame) -> DataFrame:
    """Digest columns of the runs of every document, after a tenth of them got runs planted."""
    found = find_runs(with_planted_runs(documents))
    # greatest length, then smallest start and period, as the greatest struct
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    d = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
