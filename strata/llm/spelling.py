"""Words grouped with their spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions. Two words at distance one share one of these keys:
an insertion makes the shorter word a deletion of the longer, a replacement leaves both with the same
deletion. Keys are 62-bit numbers computed from prefix sums, so that a long word costs a number for each
letter and not a copy of itself; what the join brings together is verified by exact distance, and a clash of
numbers costs a verification only. Forms are the most frequent near words, roots follow the forms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, id_crc, ship, slices, string_buffer, written

LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent as the word.
FACTOR = 10
#: Longer words go through the joins under a digest, and meet their letters for verification only.
SHORT = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PRIMES = ((2_147_483_647, 1_000_003_561), (2_147_483_629, 1_234_567_891))


def occurrences(docs: DataFrame, letters: str = r"A-Za-zÀ-ÿ", least: int = LEAST_LETTERS) -> DataFrame:
    """(word) for each maximal run of letters, A-Z in lower case, where it has ``least`` code points or more.

    A run whose crc32, written after its document's id and a colon, is divisible by 31 loses the code point at
    that number modulo its length. Null texts have no words; a null id counts as the text 'null'.
    """
    runs = F.regexp_extract_all("text", F.lit(rf"[{letters}]{{{least},}}"), 0)
    run = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "run")
    h = run.select("run", F.crc32(name.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    word = h.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.filter(F.length("word") >= least)


def counts(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words that occur at least so often; tasks add up before anything is shuffled."""
    return words.filter("word is not null").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _powers(base: int, n: int, p: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo p, in doubling steps."""
    out = np.ones(max(n, 1), np.int64)
    done, step = 1, base % p
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step % p
        done += more
        step = step * step % p
    return out[:n]


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in the column, and where each word begins (n + 1 places)."""
    data, offsets = string_buffer(column)
    first = (data & 0xC0) != 0x80
    places = np.flatnonzero(first)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.searchsorted(places, offsets)


def deletion_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each word its own key and those of its distinct single deletions.

    Letters of a run of equal ones give the same deletion, those of different runs different ones: only the last
    letter of a run is taken out. The key of a deletion is that of the deletion's own letters.
    """
    x, begins = _letters(column)
    n, sizes = len(begins) - 1, np.diff(begins)
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(x)) - np.repeat(begins[:-1], sizes)
    longest = int(sizes.max(initial=0))
    last = np.ones(len(x), bool)
    if len(x):
        last[:-1] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    whole, cut = np.zeros(n, np.int64), np.zeros(len(x), np.int64)
    for p, base in _PRIMES:
        # a word's number is the sum of its letters times powers; letters after a deletion move down one power
        sums = np.concatenate(([0], np.cumsum((x + 1) * _powers(base, longest, p)[place] % p)))
        total = (sums[begins[1:]] - sums[begins[:-1]]) % p
        before = (sums[:-1] - sums[begins[:-1]][row]) % p
        after = (sums[begins[1:]][row] - sums[1:]) % p
        gone = (before + after * pow(base, -1, p)) % p
        whole, cut = (whole << 31) | total, (cut << 31) | gone
    return np.concatenate((np.arange(n), row[last])), np.concatenate((whole, cut[last]))


def _name() -> Column:
    """A word, or a digest of a long one: no word has a sharp sign."""
    return F.when(F.length("word") <= SHORT, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2("word", 256)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) for each two different words at distance one, a < b, by their names (see ``_name``).

    ``words`` has distinct words in the column word. A key is shared by the words that one insertion makes of it,
    so a group is bounded by its length times the alphabet, not by the corpus.
    """
    ship(words.sparkSession)

    def work(batches):
        for batch in slices(batches, 1 << 20, text="word"):
            row, key = deletion_keys(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row)), pa.array(key)], names=["name", "key"])

    keys = words.select("word", _name().alias("name")).mapInArrow(work, "name string, key long")
    a, b = keys.select("key", F.col("name").alias("a")), keys.select("key", F.col("name").alias("b"))
    met = a.join(b, "key").filter("a < b").select("a", "b")
    near = lambda x, y: F.levenshtein(x, y, 1) == 1
    short = ~F.col("a").startswith("#") & ~F.col("b").startswith("#")
    # a pair that several keys bring together is one pair; what a long word takes part in needs its letters
    done = met.filter(short & near(F.col("a"), F.col("b"))).distinct()
    text = words.filter(F.length("word") > SHORT).select(_name().alias("name"), "word")
    side = lambda c: text.select(F.col("name").alias(c), F.col("word").alias(f"{c}_word"))
    rest = met.filter(~short).distinct().join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = rest.filter(near(F.coalesce("a_word", "a"), F.coalesce("b_word", "b"))).select("a", "b")
    return done.unionByName(rest)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): the form's form and so on to the last, by joins that double the steps.

    A form is FACTOR times as frequent as its word, so that no row comes back to itself. Each round's table is
    written in the shared folder: a lost executor costs one round at most.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    moved = True
    while moved:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        fresh = written(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        forget(now)
        now, moved = fresh, not fresh.filter("moved").isEmpty()
    return now


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for rows (word, n) of distinct words.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its
    near word of greatest n, ties to the smallest in code-point order, where that n is ``factor`` times its
    own or more. Its root is the last form that following forms leads to, itself without one. Words of any
    length take part, a null word does not; other columns are ignored; an empty table gives an empty one.
    """
    table = written(words.filter("word is not null").select("word", "n", _name().alias("name")), "spelling-words")
    pairs = near_pairs(table.select("word"))
    n_of = lambda c, k: table.select(F.col("name").alias(c), F.col("n").alias(k), F.col("word").alias(f"{c}_word"))
    both = pairs.join(n_of("a", "n_a"), "a").join(n_of("b", "n_b"), "b")
    each = F.explode(F.array(*[F.struct(F.col(x).alias("name"), F.col(f"n_{y}").alias("m"), F.col(f"{y}_word").alias("near")) for x, y in ("ab", "ba")]))
    best = F.min(F.struct((-F.col("m")).alias("m"), "near"))
    near = both.select(each.alias("e")).select("e.*").groupBy("name").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.m") >= F.lit(factor) * F.col("n")
    found = table.join(near, "name", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"))
    found = written(found, "spelling-forms")
    forget(table)
    last = roots(found.filter("form is not null"))
    out = found.join(last.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), F.col("n_near").cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
    out._strata_parts = [found, last]
    return out


def query(documents: DataFrame) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(counts(occurrences(documents)))


#: Distance one leaves the first three or the last three letters as they are; the letters beyond ASCII are
#: turned into single bytes, as DuckDB's distance counts bytes.
SQL = r"""WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
o AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)),
d AS (SELECT doc_id, run, count(*) AS n FROM o WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bytes FROM d),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: x::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM b, t),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
s AS (SELECT word, n, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!"#$%&()*+,-./:;<=>?@[]^_`{|') AS x FROM w),
p AS (SELECT a.word, b.word AS near, b.n FROM s a JOIN s b ON left(a.x, 3) = left(b.x, 3) AND abs(length(a.x) - length(b.x)) <= 1 WHERE levenshtein(a.x, b.x) = 1
UNION SELECT a.word, b.word, b.n FROM s a JOIN s b ON right(a.x, 3) = right(b.x, 3) AND abs(length(a.x) - length(b.x)) <= 1 WHERE levenshtein(a.x, b.x) = 1),
q AS (SELECT word, count(*) AS n_near, min((-n, near)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN -q.best[1] >= 10 * w.n THEN q.best[2] END AS form, CASE WHEN -q.best[1] >= 10 * w.n THEN -q.best[1] END AS form_n FROM w LEFT JOIN q USING (word)),
r AS (SELECT word, word AS root, 0 AS steps FROM w UNION ALL SELECT r.word, f.form, steps + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT max_by(root, steps) FROM r WHERE r.word = f.word) AS root, n, n_near, form_n FROM f"""
