"""Encoding and decoding with a SentencePiece vocabulary of merge type.

The encoding of every prefix of a text has one last token. An automaton over the vocabulary tells which
pieces end at a place; the one that can stand beside the last token of the prefix before it is the last token
there, and reading this table backwards from a text's end gives its ids. Whether two pieces can stand side by
side is found once for each pair, by merging the two alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

SPACE = "▁"
#: What an unknown id is decoded to (a fixed value).
UNKNOWN = " ⁇ "
#: Segments, and as many pairs of pieces times four, that a worker remembers in each of two generations.
REMEMBERED = 300_000
#: Longer segments are encoded where they stand and not remembered.
LONGEST_REMEMBERED = 48

ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, text string"

_CODECS: dict[str, Codec] = {}


class Codec:
    """Ids of texts and texts of ids, as the library gives them for a vocabulary of merge type.

    The vocabulary must be one that takes texts as they are, puts a space in front, has a piece for each
    character of its pieces and bytes for all others, and marks white space at the front of pieces only;
    others are refused. Then no piece spans the border before a word's first space or beside a character
    without a piece, so that texts are encoded segment by segment.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        pieces = {model.id_to_piece(i): i for i in every if not special(i)}
        alphabet = set("".join(pieces))
        plain = model.encode("a  b") == model.encode(f"a{SPACE} b") and model.decode(model.encode(" ﬁ ")) == " ﬁ "
        if not plain or SPACE not in alphabet or any(SPACE in p.lstrip(SPACE) for p in pieces) or alphabet - pieces.keys() or any(model.is_unused(i) for i in every):
            raise ValueError(f"not a vocabulary that can be encoded by segments: {path}")
        self.score = {p: model.get_score(i) for p, i in pieces.items()}
        self.piece = {i: p for p, i in pieces.items()}
        self.length = [len(self.piece.get(i, "")) for i in every]
        self.ids = {p: np.array([i], "<i4").tobytes() for p, i in pieces.items() if len(p) == 1}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.start = len(every)  # stands for the token before a segment
        self.stop = next(c for c in map(chr, range(0x110000)) if c not in alphabet)
        self.automaton = ahocorasick.Automaton()
        for p, i in pieces.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        known = "".join(map(re.escape, sorted(alphabet - {SPACE})))
        self.segments = re.compile(f"{SPACE}+[{known}]*|[{known}]+|[^{SPACE}{known}]").findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        surfaces = {i: p.replace(SPACE, " ") for i, p in self.piece.items()} | {i: UNKNOWN for i in every if model.is_unknown(i)}
        self.surface = [surfaces.get(i, "").encode() for i in every]
        for b, i in enumerate(self.byte):
            self.surface[i] = bytes([b])
        self.silent = np.array([model.is_control(i) for i in every])
        self.bytes = np.zeros(len(every), bool)
        self.bytes[self.byte] = True

    def stand(self, before: int, after: int) -> bool:
        """Whether merging the two pieces' characters gives the two pieces; the best score goes first, then the leftmost."""
        first = "" if before == self.start else self.piece[before]
        parts, border = [*first, *self.piece[after]], len(first)
        score, worst = self.score.get, float("-inf")
        while len(parts) > 1 + bool(first):
            best, at = worst, -1
            for k in range(len(parts) - 1):
                s = score(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                return False
            if first:
                left = len(parts[at]) + sum(map(len, parts[:at]))
                if left == border:
                    return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return not first or len(parts[0]) == border

    def learn(self, segments: list[str], into: dict[str, bytes]) -> None:
        """Ids of distinct segments, by the table of last tokens."""
        rare = [s for s in segments if len(s) == 1 and s not in self.score]
        for s in rare:
            into[s] = np.array([self.byte[b] for b in s.encode("utf-8", "surrogatepass")], "<i4").tobytes()
        rare = set(rare)
        segments = [s for s in segments if s not in rare]
        text = self.stop.join(segments)
        last = [self.start] * (len(text) + 1)  # of the prefix that ends before each place
        length, fits, start, solved = self.length, self.fits, self.start + 1, 0
        for end, piece in self.automaton.iter(text):
            if end == solved - 1:
                continue
            before = last[end + 1 - length[piece]]
            key = before * start + piece
            ok = fits.get(key)
            if ok is None:
                ok = fits[key] = self.stand(before, piece)
            if ok:
                last[end + 1] = piece
                solved = end + 1
        end = 0
        for s in segments:
            begin, end = end, end + len(s)
            ids, at = [], end
            while at > begin:
                ids.append(last[at])
                at -= length[last[at]]
            into[s] = np.array(ids[::-1], "<i4").tobytes()
            end += 1
        if len(fits) > 4 * REMEMBERED:
            fits.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a null is an empty text, which has none."""
        cut = [self.segments(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        young, old = self.young, self.old
        missing, long = [], {}
        for s in set().union(*cut):
            if s not in young:
                if s in old:
                    young[s] = old[s]
                else:
                    missing.append(s)
        self.learn([s for s in missing if len(s) <= LONGEST_REMEMBERED], young)
        for s in missing:
            if len(s) > LONGEST_REMEMBERED:
                self.learn([s], long)
        get = young.__getitem__
        out = [b"".join([young.get(s) or long[s] for s in c] if long else map(get, c)) for c in cut]
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes that are no UTF-8 become replacement characters, one each, and the space put in front goes."""
        parts = list(map(self.surface.__getitem__, ids.tolist()))
        loud = np.flatnonzero(~self.silent[ids])
        if len(loud) and int(ids[loud[0]]) in self.piece:
            parts[loud[0]] = parts[loud[0]].removeprefix(b" ")
        if len(loud) == len(ids):
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        out, run = [], bytearray()  # only bytes that follow one another make a character
        for is_byte, part in [*zip(self.bytes[ids].tolist(), parts, strict=True), (False, b"")]:
            if is_byte:
                run += part
                continue
            out += [_lenient(bytes(run)), part.decode()]
            run.clear()
        return "".join(out)


def _lenient(raw: bytes) -> str:
    """UTF-8 where it is valid; each other byte alone is a replacement character."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), "�"]
            raw = raw[e.start + 1 :]
    return "".join(out)


def codec(path: str) -> Codec:
    """A vocabulary's codec, built once in each worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document, without begin and end ids.

    Null and empty texts have no ids. Texts are taken whole, however long; a worker holds the table of one
    segment at a time beside the ids of a slice. Rows that repeat are encoded alike, a null doc_id stays
    null; other columns are ignored; an empty table gives an empty one. Equal scores go to the left.
    """
    ship(docs.sparkSession)

    def work(batches):
        own = codec(vocabulary or default_vocabulary())
        for batch in slices(batches, 2 << 20):
            ids = own.encode(batch.column(1).to_pylist())
            offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ENCODED)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of every list of ids; null and empty lists give empty texts. Control ids are silent, unknown ones are marked."""
    ship(encoded.sparkSession)

    def work(batches):
        own = codec(vocabulary or default_vocabulary())
        for batch in batches:
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            empty = lists.is_null().to_pylist()
            texts = ["" if none else own.decode(values[a:b]) for a, b, none in zip(offsets[:-1], offsets[1:], empty, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(work, DECODED)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` in one pass, so that ids go to no second worker. As ``encode`` otherwise."""
    ship(docs.sparkSession)

    def work(batches):
        own = codec(vocabulary or default_vocabulary())
        for batch in slices(batches, 2 << 20):
            ids = [np.frombuffer(b, "<i4") for b in own.encode(batch.column(1).to_pylist())]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, "<i4")])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([own.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ENCODED + ", decoded string")


def query(documents: DataFrame) -> DataFrame:
    """Digests of the ids of every document and of the text they give back."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return round_trip(documents).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
