"""Packing token sequences by minimum bin slack.

Documents are tokenised once and cut into pieces of at most the sequence length. Pieces of full length
are sequences of their own. The others are dealt by hash into packing groups of bounded size; within a
group, bin after bin, a subset-sum program over bitsets finds the fullest combination that fits beside
the longest piece left, and takes it out. Only lengths and coordinates are shuffled, never texts.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, mix, ship, slices, string_buffer, written

CAPACITY = 4096
END = 1
#: Pieces in a packing group, on average; a group closes at most about one sequence early.
GROUP = 20_000
#: Bytes of text that are tokenised at once; the arrays of a slice take some 50 times as much.
SLICE = 512 << 10
#: Parts of words that a worker remembers, some 60 bytes each, also while it is idle or does later stages' work.
REMEMBERED = 200_000
#: Bytes of the longest part that is remembered; longer ones are encoded once a batch.
LONGEST = 64
#: Characters of the texts whose encodings are held at once.
AT_ONCE = 50_000

_TOKENIZERS: dict = {}

_PLAIN = "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK[65:91] = _MARK[97:123] = False
#: Second bytes, after C3, of U+00DF to U+00FF but the sign of division.
_LATIN = np.zeros(256, bool)
_LATIN[0x9F:0xC0] = True
_LATIN[0xB7] = False
#: The first 0 to 8 bytes of a little-endian number.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, range after range."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' bytes (A-Z in lower case, eight more at the end), starts and lengths of their parts, and where each text's parts begin.

    Parts end at ASCII white space, and where punctuation or a digit follows one of a-z. Words with ``<|``,
    which may hold a special token, are one part and as they are; so are letters before a mark of accent,
    for h and a line below are one letter, H and a line below are not.
    """
    n = len(data)
    raw = np.zeros(n + 8, np.uint8)
    low = raw[:n]
    low[:] = _LOWER[data]
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = offsets[1:-1][offsets[1:-1] < n]
    first[edge] |= solid[edge]
    cut = np.zeros(n, bool)
    cut[1:] = _LETTER[low[:-1]] & _MARK[low[1:]]
    as_is = np.flatnonzero((low[:-1] != data[:-1]) & (data[1:] >= 0x80))
    low[as_is] = data[as_is]
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    if len(special):
        begin = np.append(np.flatnonzero(first), n)
        for w in np.unique(np.searchsorted(begin, special, "right")).tolist():
            low[begin[w - 1] : begin[w]] = data[begin[w - 1] : begin[w]]
            cut[begin[w - 1] : begin[w]] = False
    first |= cut
    last = solid
    last[:-1] &= first[1:] | ~solid[1:]
    starts = np.flatnonzero(first)
    return raw, starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, offsets)


def eight(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: int) -> np.ndarray:
    """The bytes ``at`` to ``at + 7`` of each part as a number; those past its end are 0."""
    numbers = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    return numbers[starts + at] & _BYTES[np.minimum(lengths - at, 8)]


def hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = mix(eight(raw, starts, lengths, 0) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for at in range(8, int(lengths.max(initial=0)), 8):
        on = np.flatnonzero(lengths > at)
        out[on] = mix(out[on] * np.uint64(3) ^ eight(raw, starts[on], lengths[on], at))
    return out


def same_bytes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray, others: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Whether each part equals its other one."""
    out = lengths == those
    for at in range(0, int(lengths.max(initial=0)), 8):
        on = np.flatnonzero(out & (lengths > at))
        out[on] = eight(raw, starts[on], lengths[on], at) == eight(other, others[on], lengths[on], at)
    return out


def plain(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether parts are of the letters a-z and U+00DF to U+00FF alone, which no step before the merges changes or splits."""
    here = raw[spread(starts, lengths)]
    after = _LATIN[np.append(here[1:], np.uint8(0))]
    good = _LETTER[here] | (here == 0xC3) & after
    good[1:] |= (here[:-1] == 0xC3) & after[:-1]
    ends = np.cumsum(lengths)
    bad = np.concatenate((np.zeros(1, np.int64), np.cumsum(~good)))
    return bad[ends] == bad[ends - lengths]


def encoded(tokenizer, texts: list[str]):
    """Ids of each text. Encodings, some 200 bytes a token, are held for texts of about AT_ONCE characters (or one text) only."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= AT_ONCE:
            size += len(texts[end])
            end += 1
        for e in tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False):
            yield np.array(e.ids, "<u4")
        at = end


class WordIds:
    """Token ids of texts by a tokenizer that lower-cases and whose pre-tokenizer splits on white space.

    Words between ASCII white space never share a token under such a tokenizer, nor do an ASCII letter
    and the ASCII punctuation or digit after it, so the ids of a text are those of these parts in order.
    Distinct parts are encoded once and remembered in arrays, with no object for a word: a part is found
    by its hash and compared byte by byte, so that hashes decide nothing.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model without the steps that leave plain words as they are; not for a tokenizer where a probe differs
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = " ".join(a + b for a in _PLAIN for b in _PLAIN) + " " + _PLAIN
        if self.letters.encode(probe, add_special_tokens=False).ids != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            self.letters = self.tokenizer
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.raw = np.zeros(8, np.uint8)  # bytes of the remembered parts, eight more at the end
        self.table = np.zeros(0, "<u4")  # their ids
        self.hashes = np.zeros(0, np.uint64)  # ascending
        self.known = np.zeros(0, [(name, "<i4") for name in ("start", "length", "id", "ids", "met")])

    def encode(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts, where in them each part's begin, and how many they are."""
        firsts, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        simple = plain(raw, starts, lengths)
        some = np.flatnonzero(simple)
        joined = raw[spread(starts[some], lengths[some] + 1)]
        stops = np.cumsum(lengths[some] + 1)
        joined[stops - 1] = 32
        ids, ends = self.joined(self.letters, joined.tobytes(), stops)
        if len(ends) == len(some):
            counts[some] = np.diff(ends, prepend=0)
            firsts[some] = ends - counts[some]
        else:  # not a tokenizer that keeps such words whole
            ids, simple[:] = ids[:0], False
        rest = np.flatnonzero(~simple)
        found = self.encode_each([raw[s : s + n].tobytes() for s, n in zip(starts[rest].tolist(), lengths[rest].tolist(), strict=True)])
        counts[rest] = [len(x) // 4 for x in found]
        firsts[rest] = len(ids) + np.cumsum(counts[rest]) - counts[rest]
        return np.concatenate((ids, np.frombuffer(b"".join(found), "<u4"))), firsts, counts

    def joined(self, tokenizer, words: bytes, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with a space after it, and where those of each word end; encoded 200 words at a time."""
        cuts = [0, *stops[199:-1:200].tolist(), len(words)]
        texts = [words[a : b - 1].decode() for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        ids = np.concatenate([np.zeros(0, "<u4"), *encoded(tokenizer, texts)])
        return ids, np.flatnonzero(self.ends[ids]) + 1

    def encode_each(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part; those of letters alone are encoded many at a time and cut at word ends."""
        out: list[bytes] = [b""] * len(parts)
        letters, rest = [], []
        for i, p in enumerate(parts):
            t = p.decode("utf-8", "surrogatepass")
            (letters if t.isalpha() else rest).append((i, t))
        chunks = [letters[i : i + 200] for i in range(0, len(letters), 200)]
        for chunk, ids in zip(chunks, encoded(self.tokenizer, [" ".join(t for _, t in c) for c in chunks]), strict=True):
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(chunk):  # a letter that the tokenizer turns into more than one word
                rest += chunk
                continue
            raw, start = ids.tobytes(), 0
            for (i, _), stop in zip(chunk, (ends * 4).tolist(), strict=True):
                out[i] = raw[start:stop]
                start = stop
        for (i, _), ids in zip(rest, encoded(self.tokenizer, [t for _, t in rest]), strict=True):
            out[i] = ids.tobytes()
        return out

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids begin (n + 1 places)."""
        raw, starts, lengths, bounds = parts(*string_buffer(texts))
        # distinct parts that may be remembered are numbered by their hash
        number = np.full(len(starts), -1)
        short = np.flatnonzero(lengths <= LONGEST)
        code, h = pd.factorize(hashes(raw, starts[short], lengths[short]))
        one = np.zeros(len(h), np.int64)
        one[code[::-1]] = short[::-1]
        ok = same_bytes(raw, starts[short], lengths[short], raw, starts[one][code], lengths[one][code])
        number[short[ok]] = code[ok]
        # then, by their bytes, long ones and those whose hash another one of the batch has
        others: dict[bytes, int] = {}
        left = np.flatnonzero(number < 0)
        number[left] = [len(h) + others.setdefault(raw[s : s + n].tobytes(), len(others)) for s, n in zip(starts[left].tolist(), lengths[left].tolist(), strict=True)]
        one = np.append(one, np.zeros(len(others), np.int64))
        one[number[left]] = left
        firsts, counts = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        # those remembered; of the rest, all whose hash none has are remembered
        at = np.searchsorted(self.hashes, h)
        there = np.flatnonzero(at < len(self.hashes))
        there = there[self.hashes[at[there]] == h[there]]
        known = self.known[at[there]]
        ok = same_bytes(raw, starts[one[there]], lengths[one[there]], self.raw, known["start"].astype(np.int64), known["length"])
        firsts[there[ok]], counts[there[ok]] = known["id"][ok], known["ids"][ok]
        self.known["met"][at[there[ok]]] += 1
        new = np.setdiff1d(np.arange(len(h)), there, assume_unique=True)
        ids, firsts[new], counts[new] = self.encode(raw, starts[one[new]], lengths[one[new]])
        firsts[new] += len(self.table)
        table = np.concatenate((self.table, ids))
        if len(new):
            self.remember(h[new], raw[spread(starts[one[new]], lengths[one[new]])], lengths[one[new]], table, firsts[new], counts[new])
        rest = np.append(there[~ok], np.arange(len(h), len(one)))
        if len(rest):
            ids, firsts[rest], counts[rest] = self.encode(raw, starts[one[rest]], lengths[one[rest]])
            firsts[rest] += len(table)
            table = np.concatenate((table, ids))
        firsts, counts = firsts[number], counts[number]
        places = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
        return table[spread(firsts, counts)], places[bounds]

    def remember(self, h: np.ndarray, raw: np.ndarray, lengths: np.ndarray, table: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> None:
        """Adds parts. When there are too many, those met in one batch alone go (all, if most were met again)."""
        new = np.zeros(len(h), self.known.dtype)
        new["start"] = len(self.raw) - 8 + np.cumsum(lengths) - lengths
        new["length"], new["id"], new["ids"], new["met"] = lengths, firsts, counts, 1
        order = np.argsort(h)
        at = np.searchsorted(self.hashes, h[order])
        self.hashes, self.known = np.insert(self.hashes, at, h[order]), np.insert(self.known, at, new[order])
        self.raw, self.table = np.concatenate((self.raw[:-8], raw, np.zeros(8, np.uint8))), table
        if len(self.hashes) > REMEMBERED:
            keep = self.known["met"] > 1
            keep &= keep.sum() <= REMEMBERED // 2
            self.hashes, self.known = self.hashes[keep], self.known[keep]
            k = self.known
            self.raw = np.append(self.raw[spread(k["start"], k["length"])], np.zeros(8, np.uint8))
            self.table = self.table[spread(k["id"], k["ids"])]
            k["start"] = np.cumsum(k["length"]) - k["length"]
            k["id"] = np.cumsum(k["ids"]) - k["ids"]
            k["met"] = 0

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, bounds = self.column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def tokenizer(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECES = "uid long, doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """Pieces of every document: uid, doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    A document is its text's ids and then ``end``. Null and empty texts are the end id alone. Only
    documents longer than the capacity are cut, at its multiples; very long texts are taken whole. Rows
    repeating a doc_id are cut alike. uid tells the pieces of one table apart, once it is written. Other
    columns are ignored; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    schema = PIECES + (", ids binary" if ids else "")
    tail = np.array([end], "<u4").tobytes()

    def cut(batches):
        from pyspark import TaskContext

        words = tokenizer(vocabulary or default_vocabulary())
        uid = TaskContext.get().partitionId() << 40
        for batch in slices(batches, SLICE):
            out: dict[str, list] = defaultdict(list)
            found, bounds = words.column(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                body = found[a:b].tobytes() + tail
                for piece, at in enumerate(range(0, len(body), capacity * 4)):
                    part = body[at : at + capacity * 4]
                    out["uid"].append(uid)
                    uid += 1
                    out["doc_id"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if ids:
                        out["ids"].append(part)
            fields = [("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * ids
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in fields], names=[k for k, _ in fields])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most as often as it is there, whose sum is the largest up to ``room``.

    Bitset subset sums over the lengths, longest first, stopping as soon as the room can be filled.
    """
    reach, trail, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, step = counts[length], 1
        while left > 0:
            use = min(step, left)
            if use * length > room:
                use = room // length
                left = use
                if not use:
                    break
            before = reach
            reach |= (reach << (use * length)) & mask
            if reach != before:
                trail.append((before, length, use))
            left -= use
            step *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for before, length, use in reversed(trail):
        if not before >> at & 1:
            out += [length] * use
            at -= length * use
    return out


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, by minimum bin slack around the longest one left.

    A combination that is found is used again while its lengths last.
    """
    order = np.argsort(-lengths, kind="stable")
    at: dict[int, list[int]] = defaultdict(list)
    for i in order[::-1]:
        at[int(lengths[i])].append(int(i))
    counts = {n: len(x) for n, x in at.items()}
    bins, offsets, b = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        rest = {n: c for n, c in counts.items() if c}
        found = [seed, *fullest(rest, capacity - seed)]
        counts[seed] += 1
        use: dict[int, int] = defaultdict(int)
        for n in found:
            use[n] += 1
        for _ in range(min(counts[n] // c for n, c in use.items())):
            place = 0
            for n in found:
                i = at[n].pop()
                bins[i], offsets[i] = b, place
                place += n
            b += 1
            for n, c in use.items():
                counts[n] -= c
        counts = {n: c for n, c in counts.items() if c}
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id (group * 2^32 + sequence within it) and offset.

    parts has uid, doc_id, piece and length from 1 to the capacity. Rows that repeat, and those without a
    doc_id, are packed one by one. An empty table gives an empty one.
    """
    ship(parts.sparkSession)
    groups = max(1, -(-parts.count() // GROUP))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = pdf["length"].to_numpy(np.int64)
        full = int((lengths >= capacity).sum())
        bins, offsets = pack_lengths(lengths[full:], capacity)
        seq = np.concatenate((np.arange(full), bins + full)) + (pdf["_group"].to_numpy(np.int64) << 32)
        return pdf.assign(sequence_id=seq, offset=np.concatenate((np.zeros(full, np.int64), offsets)))

    schema = parts.withColumn("_group", F.lit(0).cast("long")).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    key = F.pmod(F.xxhash64("uid"), F.lit(groups))
    return parts.withColumn("_group", key).groupBy("_group").applyInPandas(group, schema).drop("_group")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs documents; the pieces are written once, so nothing is tokenised twice.

    With ``ids``, each piece comes with its ids (little-endian unsigned 32-bit); only coordinates are packed,
    and the ids join them at the end. Nulls, repeats, long texts and empty tables are those of ``pieces``.
    """
    parts = written(pieces(docs, vocabulary, capacity, end, ids), "pieces")
    placed = pack(parts.drop("ids"), capacity)
    out = (placed.join(parts.select("uid", "ids"), "uid") if ids else placed).drop("uid")
    out._strata_parts = [parts]
    return out


def query(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
