"""SentencePiece ids, spelling variants and periodic runs on small tables, against the library and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import SF, same

from strata.llm import queries, runs, sentencepieces, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, ids string, runs int, word string, n string, root int, h int"


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=sentencepieces.default_vocabulary())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts() -> list[tuple]:
    rng = random.Random(8)
    words = lambda n: [rng.choice(["alpha", "beta", "gamma", "é", "日本", "x"]) for _ in range(n)]
    texts = [None, "", " \t\r\n", "one", "  two  spaces ", "tab\tand\r\nlines\n\n", "▁ marks▁", "\x00null", "😀 emoji 𝒳", "<s> </s> <unk> <0x0A>", "a" * 500, "ab" * 300]
    texts += [" ".join(words(rng.randrange(1, 200))) for _ in range(25)] + [" ".join(["u", "v", "w"] * 30 + words(40) + ["z"] * 9), " ".join(words(30_000)), "日本語" * 400, " " * 77]
    rows = [(i * 5 - 7, t, "x", 1, "w", "n", 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[20], (None, "null id " * 8, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_texts(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# SentencePiece


def test_ids_and_texts_are_those_of_the_library(odd, library):
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in sentencepieces.round_trip(odd).collect())
    want = Counter((d, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for d, t, *_ in odd_texts())
    assert got == want
    ids = sentencepieces.encode(odd)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == Counter(k[:2] for k in want.elements())
    assert Counter((r["doc_id"], r["text"]) for r in sentencepieces.decode(ids).collect()) == Counter((k[0], k[2]) for k in want.elements())


def test_digests_of_a_supplied_table(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.queries()["op11_sentencepiece"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_codec_on_random_pieces_and_ids(library):
    codec, rng = sentencepieces.codec(sentencepieces.default_vocabulary()), random.Random(4)
    pieces = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    alphabets = [pieces, [" ", "  ", "▁", "a", "\n", "\t", "\r"], list("abcdeht nois,."), [chr(c) for c in range(0x20, 0x250)], ["日", "本", "の", "😀", "ﬁ", "́"]]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 40))) for a in alphabets for _ in range(300)]
    assert [np.frombuffer(b, "<i4").tolist() for b in codec.encode(texts)] == library.encode(texts)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 3, 230, 132, 133, 259, 264, 28705, rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        assert codec.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_what_is_remembered_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 3)
    monkeypatch.setattr(sentencepieces, "LONGEST_REMEMBERED", 4)
    codec = sentencepieces.Codec(sentencepieces.default_vocabulary())
    for text in ["some words and longer words", "words and some", "", "longerlongerlonger words words"] * 3:
        assert np.frombuffer(codec.encode([text, None])[0], "<i4").tolist() == library.encode(text)


def test_pieces_of_empty_tables_and_lists(spark, none):
    assert sentencepieces.round_trip(none).collect() == sentencepieces.decode(sentencepieces.encode(none)).collect() == []
    lists = spark.createDataFrame([(1, None), (2, []), (3, [1, 264, 2])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in sentencepieces.decode(lists).collect()} == {1: "", 2: "", 3: "a"}


# Spelling


def near_sets(words):
    whole = set(words)
    alphabet = sorted(set("".join(words)))
    out = {}
    for w in words:
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
        put = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        swap = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        out[w] = (cut | put | swap) & whole - {w}
    return out


def variants_of(counts):
    near = near_sets(list(counts))
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 10 * n:
            form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


def collected(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_agrees_with_sql(spark):
    same(queries.queries()["op12_spelling"](spark, SF), queries.oracle_sql()["op12_spelling"])


def test_variants_match_brute_force(spark):
    rng = random.Random(2)
    counts = {}
    for _ in range(60):
        word = "".join(rng.choice("abcé") for _ in range(rng.randrange(7, 10)))
        for _ in range(rng.randrange(1, 12)):
            counts[word] = rng.choice([2, 3, 3, 20, 30, 300, 4000, 50_000])
            k = rng.randrange(len(word))
            word = word[:k] + rng.choice(["", "a", "é", "ÿb"]) + word[k + 1 :]
    counts |= {"a" * k: 7 ** (k % 5 + 1) for k in range(7, 14)}
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()] + [(None, 5, "x")], "word string, n long, key string").repartition(3)
    got = collected(spelling.variants(df))
    assert got == variants_of(counts)
    assert any(v[0] and v[1] != v[0] for v in got.values())


def test_forms_are_followed_to_the_last(spark):
    word, counts = "w" * 3 + "xyzabcd", {}
    for step in range(9):
        counts[word] = 10**step
        word = word[:step] + "q" + word[step + 1 :]
    got = collected(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == variants_of(counts)
    last = list(counts)[-1]
    assert {v[1] for v in got.values()} == {last}
    tie = {"abcdefg": 2, "abcdefx": 40, "abcdefz": 40, "éabcdefg": 40}
    assert collected(spelling.variants(spark.createDataFrame(list(tie.items()), "word string, n long")))["abcdefg"][0] == "abcdefx"


def test_long_words_meet_by_their_letters(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdef") for _ in range(3000))
    edge = "".join(rng.choice("abcdef") for _ in range(64))
    words = [base, base[:1500] + base[1501:], base[:9] + "é" + base[10:], base[:9] + base[10:] + "zz", edge, edge + "q", edge[:-1], "#" + "0" * 64]
    counts = {w: 10**i for i, w in enumerate(words[:-1], 1)}
    got = collected(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == variants_of(counts)
    assert got[base][3] == 2 and got[edge][3] == 2


def test_occurrences_match_brute_force(odd):
    counts = Counter()
    for d, t, *_ in odd_texts():
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(run) >= 4:
                counts[run] += 1
    got = {r["word"]: r["n"] for r in spelling.counts(spelling.occurrences(odd, least=4)).collect()}
    # a run of four letters that loses one is too short, one of five is not
    assert got == {w: n for w, n in counts.items() if n >= 2} and got


def test_no_words(none):
    assert spelling.query(none).collect() == []
    assert spelling.query(none.selectExpr("doc_id", "'short' as text")).collect() == []


# Runs


def runs_of(w):
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                best.setdefault((start, i + q - start), q)
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize(("levels", "places"), [(1, 5), (2, 1 << 21), (16, 1000)])
def test_runs_match_brute_force(monkeypatch, levels, places):
    monkeypatch.setattr(runs, "LEVELS", levels)
    monkeypatch.setattr(runs, "PLACES", places)
    rng = random.Random(levels)
    for _ in range(120):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60, 150]))]
            a, p = rng.randrange(len(w) // 2 + 1), rng.randrange(1, 8)
            for i in range(a, min(len(w), a + p * rng.randrange(3, 9))):
                w[i] = w[a + (i - a) % p]
            docs.append(np.array(w, np.int64))
        for w, got in zip(docs, runs.runs_of(docs), strict=True):
            assert [tuple(r) for r in got.tolist()] == runs_of(w.tolist())


def test_runs_of_odd_texts(odd, none):
    got = {(r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in runs.find_runs(odd).collect()}
    want = set()
    for d, t, *_ in odd_texts():
        w = WORD.findall(t or "")
        found = runs_of(w) if len(w) < 5000 else None
        if found is not None:
            want.add((d, len(w), tuple(found), collapsed(w, found)))
    assert want <= got and len(got) == len(want) + 1
    assert runs.find_runs(none).collect() == runs.query(none).collect() == []


def test_one_long_run(spark):
    text = " ".join(["a"] + ["b", "c", "b"] * 40_000 + ["d"])
    r = runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (r["n_words"], list(map(tuple, r["runs"])), r["collapsed"]) == (120_002, [(1, 120_000, 3)], "a b c b d")


def test_run_digests_of_a_supplied_table(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op13_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        w, h = WORD.findall(r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if n > 3000:
            continue
        found = runs_of(w)
        s, length, q = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        want = (len(found), s, length, q, 1000 * length // q if found else None, sha(lines), sha(collapsed(w, found)))
        assert tuple(got[r["doc_id"]][c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == want
