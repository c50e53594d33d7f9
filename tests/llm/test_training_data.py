"""The training-data operators on small tables, against brute force, with nulls, empties, ties and extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF, same
from pyspark.sql import functions as F

from strata.llm import common, embeddings, fingerprints, lm, minhash, mixing, packing, queries, sharding, substrings, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, key int"


def odd_texts() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "日本", "don't", "x y"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = words(70), words(120)
    texts = [None, "", " \t\n", "one", "a b c d", "A B C D", " ".join(base), " ".join(base), "\n".join(base), " ".join(base[:60] + ["changed"] + base[60:])]
    texts += [" ".join(words(30) + passage + words(rng.randrange(40))) for _ in range(6)]
    texts += [" ".join(passage), " ".join(words(6000)), "Repeat repeat " * 90, "emoji 😀 " * 5]
    texts += [" ".join(base[:i] + [f"z{i}"] + base[i + 1 :]) for i in range(3, 9)]
    rows = [(i * 3 - 4, t, "en", [None, "b", "a"][i % 3], len(t or ""), 7, "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, "null id text " * 20, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_texts(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *order):
    return df.orderBy(*order).collect()


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_near_duplicates_match_brute_force(odd):
    sets = {r[0]: shingles(r[1]) for r in odd_texts() if r[0] is not None}
    label = {i: i for i in sets}
    for _ in sets:
        for i, x in sets.items():
            for j, y in sets.items():
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    got = minhash.near_duplicates(odd, percent=85).collect()
    assert len(got) == len(odd_texts())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])


def test_second_round_joins_what_stars_miss(spark):
    """A chain in which the smallest id is linked to one end only."""
    base = [f"t{i}" for i in range(400)]
    texts, now = [], base
    for step in range(8):
        texts.append(" ".join(now))
        now = now[:]
        for j in range(3):
            now[step * 40 + j * 12 + 5] = f"c{step}{j}"
    order = [3, 0, 6, 1, 7, 2, 5, 4]
    df = spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(df, percent=85).collect()} == {0}


def test_intersections_by_matrix():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 80)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    assert minhash.intersections(sets, i, j).tolist() == [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j, strict=True)]


def brute_removed(rows, window):
    first, out = {}, {}
    for doc, text in sorted(rows):
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), doc)
    for doc, text in rows:
        w, drop = WORD.findall(text or ""), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                drop |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in drop)
        out[doc] = len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest()
    return out


def test_repeats_match_brute_force(odd):
    want = brute_removed([(r[0], r[1]) for r in odd_texts() if r[0] is not None], 50)
    got = substrings.remove_repeats(odd).collect()
    assert len(got) == len(odd_texts()) and sum(n for _, n, _ in want.values()) > 300
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
            assert r["n_removed"] or r["kept_text"] == r["text"]


def test_rows_of_one_id_are_judged_by_their_own_text(spark, none):
    passage, other = " ".join(f"p{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, passage), (2, other), (None, passage)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"][:1], r["n_removed"]) for r in substrings.remove_repeats(df).collect()), key=repr)
    assert got == [(1, "p", 0), (2, "p", 60), (2, "u", 0), (None, "p", 0)]
    kept = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert kept == [(1, 1, True), (2, 1, False), (2, 2, True), (None, None, True)]
    assert substrings.query(none).count() == minhash.query(none).count() == 0


def test_runs_skip_what_a_document_has_of_its_own(spark):
    """A document leaves a path for as many anchors as the path has there, and comes back."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    texts = [base]
    for n in range(12):
        t = base[:]
        for _ in range(3):
            at = rng.randrange(len(t) - 160)
            t[at : at + rng.randrange(1, 150)] = [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 150))]
        texts.append(t + base[n * 10 : n * 10 + 50 + n])
    rows = [(i, " ".join(t)) for i, t in enumerate(rng.sample(texts, len(texts)))]
    want = brute_removed(rows, 50)
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want


def test_words_differ_whose_powers_do_not(spark):
    """The Thue-Morse words, equal to their complements under any polynomial modulo 2^64."""
    letters = ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n)) for n in (512, 1024, 2048, 4096) for flip in (0, 1)]
    lanes, _ = common.word_hashes(pa.array(letters), lower=True, lanes=2)
    assert all(len(set(x.tolist())) == len(letters) for x in lanes)
    other = [f"v{i}" for i in range(60)]
    texts = [" ".join([*other[:30], w, *other[30:]]) for w in letters[2:]] + [w for w in letters[2:]] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_removed(list(enumerate(texts)), 50)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(df).collect()} == want
    classes = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, percent=85).collect()}
    assert classes == {i: min(j for j, t in enumerate(texts) if 100 * len(shingles(t) & shingles(texts[i])) >= 85 * len(shingles(t) | shingles(texts[i]))) for i in range(len(texts))}


def test_runs_go_by_paths(spark, monkeypatch):
    """Two rows a run; runs go on through branches; a path that is named wrongly is not gone on along."""
    rng = random.Random(3)
    base, other = ([f"{c}{rng.randrange(10**6)}" for _ in range(1500)] for c in "ab")
    branch = [*other[:300], *base[700:800], *other[300:]]  # a third document, so that base has branches
    texts = [base, branch, ["own"] * 5 + base + ["end"], branch[200:500]]
    df = spark.createDataFrame([(i, 0, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, tkey int, text string")
    cuts = lambda: {r["doc_id"]: r["cuts"] for r in substrings.decided(df).collect()}
    right = cuts()
    assert not right[0] and len(right[2]) == 2 and right[2][1] - right[2][0] > 1400
    assert len(right[3]) == 6  # its middle is kept by another document than its ends
    assert all(texts[2][right[2][0] + i] == base[right[2][0] - 5 + i] for i in range(right[2][1] - right[2][0]))
    real = substrings.compacted

    def renamed(places):
        paths, edges = real(places)
        assert paths.groupBy("first", "start").count().count() * 5 < edges.count()
        # names of paths that follow each other are no longer those of neighbours in the document
        return paths.withColumn("start", F.col("start") * 2 + 7), edges

    monkeypatch.setattr(substrings, "compacted", renamed)
    wrong = cuts()
    assert len(wrong[2]) > 2 and sum(wrong[2][1::2]) - sum(wrong[2][::2]) != right[2][1] - right[2][0]


def test_joined_runs():
    step = lambda i, start, offset, how, first=1: {"i": i, "first": first, "start": start, "offset": offset, "enters": "e" in how, "leaves": "l" in how, "ended": "x" in how}
    a, b = [step(4, 0, 3, "e"), step(9, 0, 8, "lx")], [step(10, 9, 0, "e"), step(12, 9, 2, "l")]
    assert substrings.joined_runs(a + b) == [(4, 12)]
    assert substrings.joined_runs([a[0], step(9, 0, 8, "l"), *b]) == [(4, 9), (10, 12)]  # left before its end
    assert substrings.joined_runs([*a, step(10, 9, 1, "e"), step(12, 9, 3, "l")]) == [(4, 9), (10, 12)]  # not entered at its beginning
    assert substrings.joined_runs([*a, step(10, 9, 0, "elx", first=2)]) == [(4, 9), (10, 10)]  # kept by another document
    assert substrings.joined_runs([*a, step(11, 9, 0, "el")]) == [(4, 9), (11, 11)]  # an edge between
    assert substrings.joined_runs([]) == []


def test_mix_and_plan(odd, none):
    plan = mixing.mix_plan(odd).collect()
    n = Counter(r["doc_id"] for r in mixing.mix(odd).collect())
    for r in plan:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["target"] <= 2 * r["source_size"] and 0 <= r["copies"] <= 2
    assert n == Counter({k: v for k, v in _sum_copies(plan).items() if v})
    total = {r["source"]: (r["source_size"], r["target"]) for r in plan}
    assert sum(t for _, t in total.values()) == pytest.approx(1.5 * sum(s for s, _ in total.values()))
    assert mixing.mix(odd).columns == odd.columns and mixing.query(none).count() == 0


def _sum_copies(plan):
    out = Counter()
    for r in plan:
        out[r["doc_id"]] += r["copies"]
    return out


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


def test_pieces_round_trip_and_pack(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.pack_documents(odd, capacity=64).collect()
    want = Counter()
    for r in odd_texts():
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r[0], i, i * 64, len(ids[i * 64 : i * 64 + 64]), zlib.crc32(ids[i * 64 : i * 64 + 64].tobytes())) for i in range(-(-len(ids) // 64)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and b[0][0] == 0 and sum(n for _, n in b) <= 64
    assert len(bins) <= -(-sum(r["length"] for r in got) // 64) + 1


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    t, ids, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(8)
    alphabet = list("abzA09!?.,|-'\"$ \t\n") + ["İ", "é", "e\u0301", "ß", "日", "本", "😀", "ǅ", "\u0307", "\u00a0", "Ω", "<|"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12))) for _ in range(4000)] + ["İ!", "İ?x", "x İ|"]
    got = ids.ids(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def _encoded(ids, texts):
    return [np.frombuffer(g, "<u4").tolist() for g in ids.ids(texts)]


def test_word_ids_of_capitals_with_marks():
    """h and a line below are composed to one letter, H and a line below are not, and stay two when lower-cased."""
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    texts = ["H\u0331", "T\u0308x, W\u030a! aY\u030a", "J\u030c1 h\u0331", "É\u0331! Äé, äé"]
    assert _encoded(packing.WordIds(path), texts) == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_parts_of_words_are_encoded_once():
    """Words that share letters and numbers give the tokenizer these parts once, not a text for each pair."""

    class Counting:
        def __init__(self, inner):
            self.inner, self.sent = inner, 0

        def encode_batch_fast(self, texts, **kw):
            self.sent += sum(map(len, texts))
            return self.inner.encode_batch_fast(texts, **kw)

    ids = packing.WordIds(packing.default_vocabulary())
    full = ids.tokenizer = Counting(ids.tokenizer)
    stems = ["".join(x) for x in itertools.product("abcde", repeat=3)]
    ids.ids([" ".join(f"{s}{n}" for s in stems) for n in range(200)])
    ids.ids([" ".join(f"{s}{n}" for s in stems) for n in range(200)])
    assert full.sent < 2 * (sum(map(len, stems)) + sum(len(str(n)) for n in range(200)))


@pytest.mark.parametrize("remembered, longest, kinds", [(1_000_000, 64, 1), (1_000_000, 64, 2), (30, 64, 0), (10, 3, 3)])
def test_word_ids_when_hashes_clash_and_parts_are_forgotten(monkeypatch, remembered, longest, kinds):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    monkeypatch.setattr(packing, "LONGEST", longest)
    if kinds:
        monkeypatch.setattr(packing, "hashes", lambda raw, starts, lengths: lengths.astype(np.uint64) % np.uint64(kinds))
    path = packing.default_vocabulary()
    t, ids, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(9)
    alphabet = list("abzAHT09!?.,|-'\" \t\n\x0b\x00") + ["'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "É", "é", "÷", "\u0331", "\u0338", "<", "日", "\u2003", "x" * 70]
    for n in (0, 1, 40, 40, 40, 40):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(20))) for _ in range(n)]
        assert _encoded(ids, texts) == [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert len(ids.hashes) <= max(remembered, 40 * 20)


def test_pieces_come_with_their_ids(odd, none):
    got = packing.pack_documents(odd, capacity=64, ids=True).collect()
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    assert packing.pack_documents(none).count() == 0


def test_fullest_is_fullest():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(1, 60)
        reach = {0}
        for n, c in counts.items():
            for _ in range(c):
                reach |= {x + n for x in reach if x + n <= room}
        got = packing.fullest(counts, room)
        assert sum(got) == max(reach) and all(got.count(n) <= counts[n] for n in set(got))


def test_shards(odd, none):
    got = sharding.shard(odd, 4).collect()
    assert len(got) == len(odd_texts())
    texts = {(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_texts()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == texts
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(len({r["shard"] for r in got if r["gkey"] == k}) == 1 for k in {r["gkey"] for r in got})
    assert sharding.query(none).count() == 0


def test_differencing_is_tight():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 1000) for _ in range(400)]
    parts = [p[0] for p in sharding.difference([(s, 0, 0, 0) for s in sizes])]
    sums = [sum(s for s, p in zip(sizes, parts, strict=True) if p == k) for k in range(4)]
    assert max(sums) - min(sums) <= 5


def test_shards_of_many_blocks(spark, monkeypatch):
    """Levels of blocks give every part of a block another shard, and sizes stay near equal."""
    monkeypatch.setattr(sharding, "BLOCK", 300)
    monkeypatch.setattr(sharding, "WIDE", 3)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int))").alias("a")).select("doc_id", F.concat(F.col("doc_id").cast("string"), "a").alias("text"))
    sizes = Counter()
    for r in sharding.shard(df, 4).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 4 and max(sizes.values()) - min(sizes.values()) < 0.005 * sum(sizes.values())


def test_likeness_is_near_the_share_of_common_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.query(docs).collect()}
    spans = lambda t: {t[max(0, i - fingerprints.SPAN) : i] for i in range(1, len(t) + 1)}
    off, equal = [], {}
    for k, (doc, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        for other, name in ((fingerprints.edited(text, following), "near_edited"), (following, "near_next")):
            a, b = spans(text), spans(other)
            off.append(abs(got[doc][name] - (1.0 if text == other else 2 * len(a & b) / max(1, len(a) + len(b)))))
        assert equal.setdefault(text, got[doc]["fingerprint"]) == got[doc]["fingerprint"]
    assert np.mean(off) < 0.04 and max(off) < 0.35


def test_likeness_has_no_step_at_any_length():
    text = "Spans of one length, however short or long the text is that holds them."
    of = lambda t: fingerprints.fingerprint(fingerprints.Prefix(fingerprints.code_points(t)))[0]
    for n in range(2, 60):
        assert fingerprints.likeness(of(text[:n]), of(text[: n + 1])) == pytest.approx(2 * n / (2 * n + 1)), n
    assert fingerprints.likeness(of("ab"), of("cd")) == fingerprints.likeness(of(""), of("a")) == 0
    assert fingerprints.likeness(of(""), of("")) == 1


def test_fingerprints(odd, none):
    rows = [r for r in odd_texts() if r[0] is not None]
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-r[0], r[1])) + [(None, odd_texts()[-1][1])]
    want = {}
    for i, (doc, text) in enumerate(order):
        want[doc] = hashlib.sha256(fingerprints.edited(text, order[(i + 1) % len(order)][1]).encode()).hexdigest()
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == len(odd_texts())
    doubled = {d for d, n in Counter(r[0] for r in rows).items() if n > 1}
    assert all(r["edited_sha256"] == want[r["doc_id"]] for r in got if r["doc_id"] not in doubled)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.query(none).count() == 0


def test_common_extension_is_exact():
    rng = random.Random(4)
    for _ in range(50):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))) for _ in range(2))
        p, q = fingerprints.Prefix(fingerprints.code_points(a)), fingerprints.Prefix(fingerprints.code_points(b))
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert fingerprints.common_extension(p, i, q, j) == n
        assert fingerprints.equal_spans(p, i, q, j, n) and not fingerprints.equal_spans(p, i, q, j, n + 1)


def test_trie_is_a_distribution_and_base_is_exact(spark, odd, none):
    data = b"the cat sat on the mat. the dog sat on the log. " * 4
    buf, _ = lm.stream(pa.array([data.decode()]), 3)
    g = lm.grams(buf, 3)
    levels = [np.unique(g & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(4)]
    trie = lm.Trie(levels, len(g))
    for context in (b"the", b" sa", b"xyz", b"g. "):
        c = int.from_bytes(context, "big") << 8
        assert (10 ** trie.log_probability(np.arange(256, dtype=np.uint64) + np.uint64(c))).sum() == pytest.approx(1, abs=1e-9)
    got = lm.score(odd).collect()
    docs = [(r[0], [*WORD.findall((r[1] or "").translate(LOWER)), None]) for r in odd_texts()]
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, ws in docs if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    base = {i: sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for i, ws in docs}
    assert len(got) == len(docs) and all(r["base_score"] == pytest.approx(base[r["doc_id"]]) and r["score"] < 0 and r["train_tokens"] == n for r in got)
    assert lm.score(none).count() == 0
    rng = random.Random(1)
    assert lm.adaptive_code_length(b"abab" * 40) > lm.adaptive_code_length(bytes(rng.randrange(97, 123) for _ in range(160)))


@pytest.mark.parametrize("share_bits", [3, 22])
def test_rare_grams_count_whatever_the_broadcast(spark, odd, share_bits):
    """Scores are those of the trie of all training grams, be few or all of them broadcast."""
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0
    buf, _ = lm.stream(pa.array([r[1] or "" for r in odd_texts() if not held(r[0])]))
    g = lm.grams(buf)[buf[lm.ORDER :] != lm.PAD]
    levels = [np.unique(g & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(lm.ORDER + 1)]
    trie = lm.Trie(levels, len(g))
    want = []
    for i, t, *_ in odd_texts():
        b, _ = lm.stream(pa.array([t or ""]))
        want.append((str(i), trie.log_probability(lm.grams(b)[b[lm.ORDER :] != lm.PAD]).sum()))
    got = sorted((str(r["doc_id"]), r["score"]) for r in lm.score(odd, share_bits=share_bits).collect())
    want.sort()
    assert any(held(r[0]) for r in odd_texts()) and [i for i, _ in got] == [i for i, _ in want]
    assert [v for _, v in got] == pytest.approx([v for _, v in want], rel=1e-9)


def linked(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        if x != y:
            label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_vectors(spark):
    """Planted copies at cosines from 0.9 up, in two lengths, against all pairs: links, components and what cannot link."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(300, 32))
    side -= (side * x[:300]).sum(1, keepdims=True) * x[:300]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.95, (300, 1))
    x = np.concatenate((x, c * x[:300] + np.sqrt(1 - c**2) * side, x[:5], np.repeat(x[7:8], 400, 0) + 0.01 * rng.normal(size=(400, 32))))
    short = np.array([[1.0, 2.0], [1.0, 2.1], [-1.0, 0.5], [1e300, 2e300]])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9000 + i, v.tolist(), 1) for i, v in enumerate(short)]
    odd = [(i, v, 1) for i, v in enumerate([None, [0.0] * 32, [float("nan")] * 32, [], [None] * 32, [float("inf")] * 32], 9900)] + [(None, [1.0] * 32, 1)]
    out = embeddings.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links int")).collect()
    got = {r["vec_id"]: r for r in out}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    found = sum(got[i]["n_links"] for i in range(len(u)))
    assert len(out) == len(rows) + len(odd) and links.sum() > 100_000 and 0.99 * links.sum() <= found <= links.sum()
    label = linked(len(u), [(a, b) for a, b in np.argwhere(links) if a < b and b < 3305 or a == 7])
    assert sum(got[i]["component_id"] == label[i] for i in range(len(u))) >= 0.99 * len(u)
    assert [(got[9000 + i]["n_links"], got[9000 + i]["component_id"]) for i in range(4)] == [(2, 9000), (2, 9000), (0, 9002), (2, 9000)]
    assert all(r["n_links"] == 0 and r["kept"] and r["component_id"] == r["vec_id"] for r in out if r["vec_id"] is None or r["vec_id"] >= 9900)
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_archives(spark, tmp_path):
    html = ["<p>é</p>", None, "", "<p>é</p>", "WARC/1.1\r\n\r\nWARC/1.1", None]
    rows = [(i, [None, "http://WWW.b.example/x y", "not a url\r\n"][i % 3], h, "extra") for i, h in enumerate(html)] + [(None, "http://a.example", "null id", "extra")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, captured string")
    got = warc.archive_index(df).collect()
    by = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert by == {0: ("response", None, 9), 1: ("response", None, 0), 2: ("revisit", 1, 0), 3: ("revisit", 0, 9), 4: ("response", None, 20), 5: ("revisit", 1, 0), None: ("response", None, 7)}
    assert [r["urlkey"] for r in got] == sorted(r["urlkey"] for r in got)
    assert warc.archive_index(df.limit(0)).count() == 0


def test_archives_are_members_that_can_be_sought(spark, tmp_path, monkeypatch):
    """Large pages, a record of several members, repeated ids; each index offset begins a readable gzip stream."""
    import gzip

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4 << 20)
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1 << 20)
    rng = random.Random(3)
    html = ["small", "x" * 3_000_000, "".join(rng.choice("abc é") for _ in range(900_000)), "small", "y" * 5_000_000]
    rows = [(i, f"http://h{i}.example/", h) for i, h in enumerate(html)] + [(3, "http://again.example/", "small")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = f"file://{tmp_path}/w"
    got = warc.archive_index(df, keep=path).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["record_type"]) for r in got) == Counter((i, len(h.encode()), "revisit" if i == 3 else "response") for i, _, h in rows)
    files = {f.name: f.read_bytes() for f in (tmp_path / "w").glob("part-*")}
    assert len(files) > 2
    for r in got:
        whole = gzip.decompress(files[r["run"]][r["record_offset"] :])
        assert whole.startswith(b"WARC/1.1") and f"WARC-Record-ID: <urn:x-page:{r['page_id']}>".encode() in whole[:300]


@pytest.mark.parametrize("k", range(9))
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(7))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_toxicity_ignores_group_mentions(spark, odd):
    rng = random.Random(6)
    filler = [f"n{i}" for i in range(50)]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 2
        words = [rng.choice(filler) for _ in range(12)] + (["idiot"] if toxic else ["thanks"]) + (["muslim"] if toxic and i % 4 == 1 else [])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fair, plain = toxicity.train(d, lab), toxicity.train(d, lab, fairness=0.0)
    swap = lambda m: abs(m.logit({"muslim", "n1"}) - m.logit({"queer", "n1"}))
    assert swap(fair) < 0.5 * swap(plain)
    got = toxicity.score(d, fair).join(lab, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) > 0.97 * len(got)
    assert toxicity.score(odd, fair).count() == len(odd_texts())
    assert toxicity.train(d.limit(0), lab.limit(0)).bias < 0


def test_scores_are_those_of_the_model(spark):
    """On the supplied table: the query gives the fitted model's logits, and tells held-out rows apart."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.query(docs, labels).collect()}
    for r in docs.collect():
        score = 1 / (1 + np.exp(-model.logit(toxicity.words_of(r["text"]))))
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-9) and got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    again = toxicity.train(docs.union(docs.limit(50)), labels)
    assert again.weights == pytest.approx(model.weights)


def test_stages_on_odd_rows(spark, odd, none):
    """Nulls, empty texts, repeated rows, clashing columns and empty tables, stage by stage."""
    import corpus_pipeline

    clash = ("score", "predicted", "kept", "component_id", "_id", "n_words", "kept_text", "text_key")
    odd = odd.select("*", *[F.lit(7).alias(c) for c in clash])
    stages = dict(corpus_pipeline.STAGES)
    left = stages["near_duplicates"](spark, odd, SF)
    sets = {r[0]: shingles(r[1]) for r in odd_texts() if r[0] is not None}
    ids = sorted(sets)
    near = [(i, j) for i in range(len(ids)) for j in range(i) if (x := sets[ids[i]]) and (y := sets[ids[j]]) and 100 * len(x & y) >= 80 * len(x | y)]
    label = linked(len(ids), near)
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([ids[i] for i in range(len(ids)) if label[i] == i] + [None], key=repr)
    cut = {r["doc_id"]: r for r in stages["substring_dedup"](spark, odd, SF).collect()}
    want = brute_removed([(r[0], r[1]) for r in odd_texts() if r[0] is not None], 50)
    for r in odd_texts():
        if r[0] is not None:
            kept = cut[r[0]]["text"]
            assert (hashlib.sha256(" ".join(WORD.findall(kept or "")).encode()).hexdigest() == want[r[0]][2]) if want[r[0]][1] else kept == r[1]
            assert cut[r[0]]["n_chars"] == (len(kept) if want[r[0]][1] else r[4])
    for name in ("toxicity", "near_duplicates", "substring_dedup", "mixing"):
        for table in (odd, none):
            out = stages[name](spark, table, SF)
            assert out.columns == table.columns and (table is odd or out.count() == 0)
    assert stages["toxicity"](spark, odd, SF).select(*clash).distinct().collect() in ([tuple([7] * 8)], [])
    assert stages["packing"](spark, odd, SF).count() >= len(odd_texts()) and stages["packing"](spark, none, SF).count() == 0


def test_pipeline_end_to_end(spark):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        docs = out
    assert corpus_pipeline.run(spark, SF).select(F.sum("length")).collect()[0][0] > 0
