"""Toxicity by a counterfactually regularised linear classifier.

A logistic model over the words that occur in a text is fitted on a bounded sample of labelled rows.
For every training text that names a group, the identity term is swapped for other ones, and the mean
squared change of the logit is penalised, so that a mention of a group alone does not move the score.
Fitting happens on the driver over at most ``MOST_TRAINING`` rows; scoring runs over whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.batches import release

from .common import forget, id_crc, ship, slices, written

#: Labelled rows that the model is fitted on at most: those with the smallest hashes of their id.
MOST_TRAINING = 8_000
#: Training rows that a feature with a weight is in at least.
LEAST_ROWS = 2
#: Standard errors between the labels from which on a feature has the plain ridge penalty.
SURE = 3.5
#: Lengths of the word beginnings that are features beside the words.
STEMS = (4, 5, 6, 7)
#: What a row of label 1 weighs in the fit, against 1 for a row of label 0.
POSITIVE = 3.0
#: Group mentions that must not decide a score (fixed values).
IDENTITY = (
    "asian", "atheist", "black", "blind", "buddhist", "catholic", "christian", "deaf", "disabled", "elderly",
    "female", "gay", "hindu", "immigrant", "jewish", "latino", "lesbian", "male", "muslim", "old",
    "queer", "refugee", "straight", "transgender", "white", "woman", "man", "young",
)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a whole text, lower case, without punctuation at their ends."""
    if not text:
        return set()
    out = {w if w.isalnum() else _EDGES.sub("", w) for w in set(text.lower().split())}
    out.discard("")
    return out


def features(words: set[str]) -> set[str]:
    """The words and, marked by a star, their beginnings: compounds and inflections share those."""
    out = set(words)
    for n in STEMS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


@dataclass
class Model:
    """A bias and a weight a feature, kept as two columns; only where texts are scored they become a dictionary."""

    bias: float = 0.0
    names: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @cached_property
    def weights(self) -> dict[str, float]:
        return dict(zip(self.names.to_pylist(), self.values.tolist(), strict=True))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "weights"}

    def logit(self, words: set[str]) -> float:
        w = self.weights
        found = {x for x in words if x in w}
        for n in STEMS:
            found.update(x for x in {y[:n] + "*" for y in words if len(y) > n} if x in w)
        return self.bias + math.fsum(w[x] for x in found)


#: How far along the list of identity terms the partners of a swap stand; the fit takes the mean over them.
SWAPS = (1, 5, 11)


def swapped(words: set[str], identity: tuple[str, ...] = IDENTITY, step: int = 1) -> set[str] | None:
    """The words after every identity term is replaced by the one ``step`` further on the list; None without such a term."""
    place = {w: i for i, w in enumerate(identity)}
    found = {w for w in words if w in place}
    if not found:
        return None
    return (words - found) | {identity[(place[w] + step) % len(identity)] for w in found}


#: Entries of a sparse matrix that a product works on at once.
BLOCK = 1 << 19


@dataclass
class Lists:
    """A sparse matrix of 0, 1 and -1 by lists of columns; column -1 is a constant where ``ones`` is set.

    The driver holds four bytes an entry, one more where entries are negative; products go block by block.
    """

    columns: np.ndarray
    signs: np.ndarray | None  # None: no entry is negative
    starts: np.ndarray
    ones: bool

    @classmethod
    def of(cls, signed: np.ndarray, lengths: np.ndarray, ones: bool) -> Lists:
        """signed: column + 1, negative where the entry is -1; lengths: entries of each row."""
        columns = np.abs(signed).astype(np.int32, copy=False)
        columns -= 1
        return cls(columns, np.sign(signed).astype(np.int8) if (signed < 0).any() else None, np.append(0, np.cumsum(lengths, dtype=np.int64)), ones)

    @property
    def n(self) -> int:
        return len(self.starts) - 1

    def blocks(self):
        """(rows, entries, lengths) of as many whole rows as BLOCK entries hold, one at least."""
        at = 0
        while at < self.n:
            end = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + BLOCK, "right")) - 1)
            yield slice(at, end), slice(self.starts[at], self.starts[end]), np.diff(self.starts[at : end + 1])
            at = end

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for rows, entries, lengths in self.blocks():
            v = w[self.columns[entries]]
            if self.signs is not None:
                v *= self.signs[entries]
            out[rows] = np.bincount(np.repeat(np.arange(len(lengths)), lengths), v, len(lengths))
        return out + (w[-1] if self.ones else 0.0)

    def back(self, r: np.ndarray, m: int, squares: bool = False) -> np.ndarray:
        out = np.zeros(m)
        for rows, entries, lengths in self.blocks():
            v = np.repeat(r[rows], lengths)
            if self.signs is not None and not squares:
                v *= self.signs[entries]
            out += np.bincount(self.columns[entries], v, m)
        if self.ones:
            out[-1] = r.sum()
        return out


def solve(x: Lists, y: np.ndarray, change: Lists, penalty: np.ndarray, fairness: float = 5.0, rounds: int = 25) -> np.ndarray:
    """Newton's method on the log loss, an L2 term by feature and the squared logit change under swapped identities.

    x: features of each row; change: the features that a swap takes (1) and brings (-1), one row a swap, the
    swaps of a text together weighing 1; penalty: by feature, the last one is the constant's. The steps come
    from conjugate gradients, so that no matrix of features by features is built.
    """
    m, c, w = len(penalty), np.where(y > 0, POSITIVE, 1.0), np.zeros(len(penalty))
    fair = 2 * fairness / len(SWAPS)

    def loss(w: np.ndarray) -> float:
        z = x.times(w)
        return float((c * (np.logaddexp(0, z) - y * z)).sum() + penalty @ (w * w) / 2 + fair * (change.times(w) ** 2).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        curve = c * p * (1 - p)
        slope = x.back(c * (p - y), m) + penalty * w + fair * change.back(change.times(w), m)
        scale = x.back(curve, m, squares=True) + penalty + fair * change.back(np.ones(change.n), m, squares=True) + 1e-9
        step, left = np.zeros(m), -slope
        towards = left / scale
        size = left @ towards
        enough = 1e-4 * size
        for _ in range(200):
            if size <= enough:
                break
            bent = x.back(curve * x.times(towards), m) + penalty * towards + fair * change.back(change.times(towards), m)
            far = size / (towards @ bent)
            step, left = step + far * towards, left - far * bent
            better = left / scale
            size, before = left @ better, size
            towards = better + size / before * towards
        now, part = loss(w), 1.0
        while part > 1e-3 and loss(w + part * step) > now:
            part /= 2
        w = w + part * step
        if np.abs(part * step).max() < 1e-5:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(id, y, text): labelled rows out of the held-out fold, the MOST_TRAINING smallest by a hash of the id.

    Null ids, labels or texts teach nothing. Conflicting labels of one id are both used. Where rows of the
    documents repeat an id, the one whose text has the smallest digest teaches.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (id_crc("doc_id", folds) != 0)).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "y").limit(MOST_TRAINING)  # a bounded table
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), "text")
    found = texts.join(F.broadcast(known.distinct()), "id")
    return found.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, identity: tuple[str, ...] = IDENTITY, ridge: float = 1.0, **how) -> Model:
    """Fits the model; executors count features and index rows, the driver gets names and index lists of the bounded sample.

    Every feature that LEAST_ROWS training rows hold has a weight, whatever the size of the sample. The ridge
    penalty of a feature whose presence differs by z standard errors between the labels is (SURE / z)^2 times
    that of a sure one, so weak features are shrunk and none is left out. Without rows of both labels the
    model is a constant.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = written(training_rows(docs, labels, folds), "labelled")

    def count(batches):
        seen: Counter = Counter()
        for batch in slices(batches, 8 << 20):
            for y, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen.update((f, y) for f in features(words_of(t)))
        items = list(seen.items())
        for s in range(0, len(items), 100_000):
            part = items[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part]), pa.array([k[1] for k, _ in part], pa.int32()), pa.array([v for _, v in part], pa.int64())], names=["feature", "y", "n"])

    total = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos or not neg:
        forget(rows)
        return Model(bias=4.0 if pos else -4.0)
    counts = rows.mapInArrow(count, "feature string, y int, n long").groupBy("feature").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    held = counts.filter((F.col("a") + F.col("b") >= LEAST_ROWS) | F.col("feature").isin(list(identity))).toArrow()
    p, q = (held.column(1).to_numpy() + 0.5) / (pos + 1), (held.column(2).to_numpy() + 0.5) / (neg + 1)
    z = np.abs(p - q) / np.sqrt(p * np.abs(1 - p) / (pos + 1) + q * np.abs(1 - q) / (neg + 1) + 1e-12)
    names = held.column(0).combine_chunks()
    named = set(names.filter(pc.is_in(names, pa.array(identity, names.type))).to_pylist())
    brought = sorted({swapped({g}, identity, step).pop() for g in named for step in SWAPS} - named)  # by swaps alone
    names, z = pa.concat_arrays([names, pa.array(brought, names.type)]), np.append(z, np.zeros(len(brought)))
    order = pc.sort_indices(names)
    names, z = names.take(order), z[order.to_numpy()]
    penalty = np.append(ridge * np.maximum(1.0, SURE / np.maximum(z, 0.05)) ** 2, 0.0)
    del held, p, q, z, order
    shared = spark.sparkContext.broadcast(names)

    def index(batches):
        column = {f: j for j, f in enumerate(shared.value.to_pylist(), 1)}
        for batch in slices(batches, 8 << 20):
            xs, zs = [], []
            for t in batch.column(2).to_pylist():
                words = words_of(t)
                own = {column[f] for f in features(words) if f in column}
                xs.append(sorted(own))
                others = [{column[f] for f in features(x) if f in column} for x in (swapped(words, identity, step) for step in SWAPS) if x is not None]
                zs.append([[*sorted(own - o), *sorted(-j for j in o - own)] for o in others])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(xs, pa.list_(pa.int32())), pa.array(zs, pa.list_(pa.list_(pa.int32())))], names=["id", "y", "x", "z"])

    table = rows.select(F.col("id").cast("long"), "y", "text").mapInArrow(index, "id long, y int, x array<int>, z array<array<int>>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    forget(rows)
    shared.destroy()

    def lists(column, ones: bool) -> Lists:
        column = column.combine_chunks()
        return Lists.of(pc.list_flatten(column).to_numpy(), pc.list_value_length(column).to_numpy().astype(np.int64), ones)

    x, y, change = lists(table.column("x"), True), table.column("y").to_numpy().astype(float), lists(pc.list_flatten(table.column("z")), False)
    del table
    w = solve(x, y, change, penalty, **how)
    del x, change
    release()
    return Model(float(w[-1]), names, w[:-1])


def score(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with score and predicted. Null and empty texts get the score of no words; very long ones are read whole.

    Only the text is read by the model. Columns of docs named like the two that are added are replaced; rows
    that repeat are scored alike; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    base = docs.drop(score, predicted)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the features of at most MOST_TRAINING texts
    place = base.columns.index(text)

    def apply(batches):
        m = shared.value
        for batch in slices(batches, 8 << 20, text):
            logits = np.array([m.logit(words_of(t)) for t in batch.column(place).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, score, predicted])

    schema = base.withColumn(score, F.lit(0.0)).withColumn(predicted, F.lit(0)).schema
    for f in schema.fields:
        f.nullable = True
    return base.mapInArrow(apply, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", (id_crc("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
