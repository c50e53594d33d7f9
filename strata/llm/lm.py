"""Language-model scores by prediction by partial matching over bytes.

The pretrained model is a trie of byte contexts up to ORDER. A symbol seen in a context has probability
c / (T + D) there (c its count, T the context's, D its distinct symbols); the escape, (T - kept + D) /
(T + D), goes to the next shorter context, from which the symbols already seen are excluded. A document
is its bytes with A-Z in lower case and then an end symbol; its score is the sum of log10 probabilities.

Counts come from all training documents: every task counts its grams with numpy, Spark sums them, and
shorter grams are sums of longer ones. No gram is left out. The model is a table of the grams of ORDER + 1
bytes that any document has, with the log10 probability of their last byte: grams that training has seen
meet their context, the others go down the orders by joins. Grams whose share of all training bytes is at
least 2^-SHARE_BITS (so at most 2^SHARE_BITS of them) are broadcast; all other (document, gram) pairs meet
their probability in a join. ``Trie`` is the same model in memory.

The unigram baseline counts words of all training documents. Words of at least 2^-WORD_BITS of all tokens
(so at most 2^WORD_BITS of them) are broadcast; all other (document, word) pairs meet their counts in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, id_crc, mix, ship, slices, string_buffer, word_hashes, written

ORDER = 5
SHARE_BITS = 22
WORD_BITS = 19
#: Bytes that no UTF-8 text has, for the begin and the end of a document.
PAD, END = 0xFE, 0xFF

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def stream(column: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each after ``order`` begin symbols and before an end symbol, and where each text begins."""
    data, offsets = string_buffer(column)
    n = len(offsets) - 1
    out = np.full(len(data) + n * (order + 1), PAD, np.uint8)
    begin = offsets[:-1] + np.arange(n) * (order + 1) + order
    lengths = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(begin - offsets[:-1], lengths)
    out[place] = _LOWER[data]
    out[begin + lengths] = END
    return out, begin


def grams(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The last order + 1 bytes up to each place from ``order`` on, packed into 64 bits."""
    n = len(data) - order
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(order, -1, -1):
        out <<= np.uint64(8)
        out |= data[order - j : order - j + n]
    return out


class Table:
    """A fixed map from 64-bit keys to places, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 1)
        slot = self._slot(keys)
        self.order = np.argsort(slot, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.first = np.searchsorted(slot[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where there is none."""
        out = np.full(len(q), -1, np.int32)
        if not len(self.keys):
            return out
        slot = self._slot(q)
        at, stop = self.first[slot], self.first[slot + 1]
        del slot
        todo = np.flatnonzero(at < stop)
        at, stop, q = at[todo], stop[todo], q[todo]
        while len(todo):
            hit = self.keys[at] == q
            out[todo[hit]] = self.order[at[hit]]
            go = ~hit & (at + 1 < stop)
            todo, at, stop, q = todo[go], at[go] + 1, stop[go], q[go]
        return out


class Trie:
    """A PPM trie, as one table of grams and one of contexts per order.

    levels[k]: (grams, counts) of k + 1 bytes; total: count of all training bytes, end symbols included.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], total: int):
        self.grams, self.logs, self.contexts, self.escapes = [], [], [], []
        upper = np.zeros(1, np.uint64), np.array([total], np.int64)
        for k, (g, c) in enumerate(levels):
            order = np.argsort(g)
            g, c = g[order], c[order].astype(np.int64)
            node, start = np.unique(g >> np.uint64(8), return_index=True) if k else (np.zeros(min(1, len(g)), np.uint64), np.zeros(min(1, len(g)), np.int64))
            if len(g):
                kept, distinct = np.add.reduceat(c, start), np.diff(np.append(start, len(g)))
                place = Table(upper[0]).find(node)
                # a begin symbol is never predicted, so contexts within the padding have no count of their own
                all_of = np.where(place >= 0, upper[1][np.maximum(place, 0)], kept)
                all_of = np.maximum(all_of, kept)
                owner = np.repeat(np.arange(len(node)), distinct)
                log = np.log10(c / (all_of + distinct)[owner])
                lower = 10.0 ** self.log_probability(g, k - 1)
                rest = np.maximum(1 - np.add.reduceat(lower, start), 1e-12)
                escape = np.log10((all_of - kept + distinct) / (all_of + distinct) / rest)
            else:
                log = escape = np.zeros(0)
            self.grams.append(Table(g))
            self.logs.append(log)
            self.contexts.append(Table(node))
            self.escapes.append(escape)
            upper = g, c

    def log_probability(self, g: np.ndarray, order: int | None = None) -> np.ndarray:
        """log10 probability of each gram's last byte after its other bytes."""
        k = len(self.grams) - 1 if order is None else order
        out, todo = np.zeros(len(g)), np.arange(len(g))
        while k >= 0 and len(todo):
            q = g[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = self.grams[k].find(q)
            hit = at >= 0
            out[todo[hit]] += self.logs[k][at[hit]]
            todo, q = todo[~hit], q[~hit]
            if not len(todo):
                return out
            node = self.contexts[k].find(q >> np.uint64(8))
            known = node >= 0
            out[todo[known]] += self.escapes[k][node[known]]
            k -= 1
        out[todo] -= np.log10(256.0)  # below order 0: all bytes alike
        return out


def adaptive_code_length(data: bytes, order: int = ORDER) -> float:
    """log10 probability of one text under a trie that starts empty and learns each byte after coding it."""
    seen: dict[bytes, dict[int, int]] = {}
    text, out = data.translate(_LOWER.tobytes()) + bytes([END]), 0.0
    for i, s in enumerate(text):
        barred: set[int] = set()
        done = False
        for k in range(min(order, i), -1, -1):
            node = seen.get(text[i - k : i])
            if not node:
                continue
            live = {t: c for t, c in node.items() if t not in barred}
            if not live:
                continue
            total = sum(live.values()) + len(live)
            if s in live:
                out += np.log10(live[s] / total)
                done = True
                break
            out += np.log10(len(live) / total)
            barred |= live.keys()
        if not done:
            out -= np.log10(256 - len(barred))
        for k in range(min(order, i) + 1):
            node = seen.setdefault(text[i - k : i], {})
            node[s] = node.get(s, 0) + 1
    return float(out)


#: Stands for the end of a document among word hashes.
_END_WORD = np.uint64(0x00E0DE0DE0DE0D00)


#: Kinds of keys: grams, words, and rows that stand for a whole document.
GRAM, WORD, WHOLE = 0, 1, 2


def count_all(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, n): the grams of all documents and the words of training ones, with their counts in training documents.

    ``docs`` has text and held; a gram that only held-out documents have counts 0.
    """

    def apply(batches):
        tables: list[list] = [[], []]

        def fold(kind):
            keys, counts = (np.concatenate(x) for x in zip(*tables[kind], strict=True))
            u, inv = np.unique(keys, return_inverse=True)
            tables[kind] = [(u, np.bincount(inv, weights=counts, minlength=len(u)).astype(np.int64))]

        def add(kind, values, weight):
            u, n = np.unique(values, return_counts=True)
            tables[kind].append((u, n * weight))
            if sum(len(k) for k, _ in tables[kind][1:]) > 2_000_000:
                fold(kind)

        for batch in slices(batches, 4 << 20):
            for held in (False, True):
                column = batch.column(0).filter(pc.equal(batch.column(1), held))
                if not len(column):
                    continue
                data, _ = stream(column, order)
                add(GRAM, grams(data, order)[data[order:] != PAD], int(not held))
                if not held:
                    (h,), _ = word_hashes(column, lower=True)
                    add(WORD, np.append(h, np.full(len(column), _END_WORD)), 1)
        for kind in (GRAM, WORD):
            if tables[kind]:
                fold(kind)
                u, n = tables[kind][0]
                for s in range(0, len(u), 100_000):
                    part = u[s : s + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[s : s + 100_000])], names=["kind", "key", "n"])

    counted = docs.select("text", "held").mapInArrow(apply, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _last(key: str, n: int) -> Column:
    """The last n bytes of a packed gram."""
    return F.col(key).bitwiseAND(F.lit((1 << 8 * n) - 1)) if n < 8 else F.col(key)


def _small(table: DataFrame, n: int) -> DataFrame:
    """Tables with keys of at most two bytes have at most 65 536 rows and are broadcast."""
    return F.broadcast(table) if n <= 2 else table


def model(counts: DataFrame, order: int) -> DataFrame:
    """(key, n, log): every counted gram of order + 1 bytes with its count in training and its log10 probability."""
    levels = {order: counts.filter("n > 0").select("key", "n")}
    for k in range(order - 1, -1, -1):
        levels[k] = written(levels[k + 1].select(_last("key", k + 1).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    # contexts[k]: ctx of k bytes, mass = T + D, and the escape to order k - 1, from which seen symbols are excluded
    contexts = {}
    for k in range(order + 1):
        g = levels[k].withColumn("ctx", F.shiftrightunsigned("key", 8)).withColumn("_suffix", _last("key", k))
        if not k:
            c = g.groupBy("ctx").agg(F.sum("n").alias("t"), F.count("*").alias("d")).withColumn("rest", 1 - F.col("d") / 256)
        else:
            lower = levels[k - 1].select(F.col("key").alias("_suffix"), F.col("n").alias("m"))
            c = g.join(_small(lower, k), "_suffix").groupBy("ctx").agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.sum("m").alias("s")).withColumn("_lower", _last("ctx", k - 1))
            upper = contexts[k - 1].select(F.col("ctx").alias("_lower"), F.col("mass").alias("_mass"))
            c = c.join(_small(upper, k - 1), "_lower").withColumn("rest", 1 - F.col("s") / F.col("_mass"))
        mass = F.col("t") + F.col("d")
        contexts[k] = written(c.select("ctx", mass.alias("mass"), F.log10(F.col("d") / mass / F.col("rest")).alias("escape")), "contexts")
    seen = levels[order].withColumn("ctx", F.shiftrightunsigned("key", 8)).join(contexts[order], "ctx").select("key", "n", F.log10(F.col("n") / F.col("mass")).alias("log"))
    new = counts.filter("n = 0").select("key", F.lit(0.0).alias("log"), F.lit(False).alias("done"))
    for k in range(order, -1, -1):
        new = new.withColumn("ctx", F.shiftrightunsigned(_last("key", k + 1), 8)).join(_small(contexts[k], k), "ctx", "left").drop("ctx")
        hit = F.lit(False)
        if k < order:
            new = new.withColumn("_g", _last("key", k + 1)).join(_small(levels[k].select(F.col("key").alias("_g"), "n"), k + 1), "_g", "left")
            hit = F.col("n").isNotNull()
        step = F.when(hit, F.log10(F.col("n") / F.col("mass"))).otherwise(F.coalesce("escape", F.lit(0.0))) if k < order else F.coalesce("escape", F.lit(0.0))
        new = new.select("key", F.when(F.col("done"), F.col("log")).otherwise(F.col("log") + step).alias("log"), (F.col("done") | hit).alias("done"))
    # below order 0 all bytes are alike
    new = new.select("key", F.lit(0).cast("long").alias("n"), F.when(F.col("done"), F.col("log")).otherwise(F.col("log") - F.log10(F.lit(256.0))).alias("log"))
    out = written(seen.unionByName(new), "model")
    forget(*[levels[k] for k in range(order)], *contexts.values())
    return out


def score(docs: DataFrame, folds: int = 10, order: int = ORDER, share_bits: int = SHARE_BITS, word_bits: int = WORD_BITS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id modulo ``folds`` is 0 teach nothing. Null and empty texts are an end
    alone. Rows that repeat a doc_id are scored one by one. Other columns are ignored. An empty table
    gives an empty one; without training rows every byte is as likely as any other.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col("doc_id").cast("long"), "text", (id_crc("doc_id", folds) == 0).alias("held"))
    counts = written(count_all(d.select(F.coalesce("text", F.lit("")).alias("text"), "held"), order), "counts")
    known_grams = model(counts.filter(F.col("kind") == GRAM).select("key", "n"), order)
    total = known_grams.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    least = max(1, -(-total // (1 << share_bits)))
    common = known_grams.filter(F.col("n") >= least).select("key", "log").toArrow()
    gram_logs = common["key"].to_numpy().view(np.uint64), common["log"].to_numpy()
    words = counts.filter(F.col("kind") == WORD).select(F.col("key").alias("hash"), F.col("n").alias("c"))
    n_all, v_all = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).collect()[0]
    often = words.filter(F.col("c") >= max(1, -(-n_all // (1 << word_bits)))).toArrow()
    order_w = np.argsort(often["hash"].to_numpy().view(np.uint64))
    known = often["hash"].to_numpy().view(np.uint64)[order_w], often["c"].to_numpy()[order_w].astype(np.int64)
    shared = spark.sparkContext.broadcast((gram_logs, known))
    floor = float(np.log10(n_all + 0.1 * (v_all + 1)))

    def grams_of(column):
        data, begin = stream(column, order)
        sizes = np.diff(np.append(begin, len(data) + order)) - order
        return grams(data, order)[data[order:] != PAD], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def split(table, logs, keys, owner, rows):
        """Sum and number of the logs of each row's broadcast keys, and the other keys with their rows."""
        at = table.find(keys)
        hit = at >= 0
        who = owner[hit]
        return np.bincount(who, weights=logs[at[hit]], minlength=rows).astype(np.float64), np.bincount(who, minlength=rows), keys[~hit], owner[~hit]

    def apply(batches):
        from pyspark import TaskContext

        (gram, log), (frequent, count) = shared.value
        table, place = Table(gram), Table(frequent)
        log_c = np.log10(count + 0.1)
        uid = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 2 << 20):
            rows, column = batch.num_rows, batch.column(1)
            value, _, *rare_grams = split(table, log, *grams_of(column), rows)
            (h,), bounds = word_hashes(column, lower=True)
            size = np.diff(bounds)
            owner = np.repeat(np.arange(rows), size)
            owner, h = np.append(owner, np.arange(rows)), np.append(h, np.full(rows, _END_WORD))
            part, sure, *rare_words = split(place, log_c, h, owner, rows)
            ids = uid + np.arange(rows)
            uid += rows
            whole = [pa.array(np.full(rows, WHOLE, np.int32)), batch.column(0), pa.array(mix(ids.astype(np.uint64)).view(np.int64)), pa.array((size + 1).astype(np.int64)), pa.array(sure.astype(np.int64)), pa.array(part), pa.array(value)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *whole], names=names)
            for kind, (miss, who) in ((GRAM, rare_grams), (WORD, rare_words)):
                by = np.lexsort((miss, who))
                miss, who = miss[by], who[by]
                new = np.flatnonzero(np.r_[True, (miss[1:] != miss[:-1]) | (who[1:] != who[:-1])]) if len(miss) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(miss)))
                for s in range(0, len(new), 100_000):
                    t = new[s : s + 100_000]
                    none, kinds = pa.nulls(len(t), pa.float64()), pa.array(np.full(len(t), kind, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who[t]]), kinds, pa.nulls(len(t), pa.int64()), pa.array(miss[t].view(np.int64)), pa.array(n[s : s + 100_000].astype(np.int64)), pa.nulls(len(t), pa.int64()), none, none], names=names)

    names = ["uid", "kind", "doc_id", "hash", "n", "sure", "part", "value"]

    scored = d.select("doc_id", "text").mapInArrow(apply, "uid long, kind int, doc_id long, hash long, n long, sure long, part double, value double")
    rare_grams = known_grams.filter(F.col("n") < least).select(F.lit(GRAM).alias("kind"), F.col("key").alias("hash"), F.lit(None).cast("long").alias("c"), "log")
    meets = rare_grams.unionByName(words.select(F.lit(WORD).alias("kind"), "hash", "c", F.lit(None).cast("double").alias("log")))
    joined = scored.join(meets, ["kind", "hash"], "left")
    c = F.coalesce("c", F.lit(0))
    whole, word = F.col("kind") == WHOLE, F.col("kind") == WORD
    by_doc = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(whole, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(word & (c > 0), F.col("n")).when(whole, F.col("sure")).otherwise(0)).alias("n_known"),
        F.sum(F.when(word, F.col("n") * F.log10(c + 0.1)).when(whole, F.col("part")).otherwise(0.0)).alias("logs"),
        F.sum(F.when(whole, F.col("value")).when(~word, F.col("n") * F.col("log")).otherwise(0.0)).alias("score"))
    return by_doc.select(
        "doc_id", (id_crc("doc_id", folds) == 0).alias("held_out"), "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score")


def query(docs: DataFrame) -> DataFrame:
    return score(docs)
