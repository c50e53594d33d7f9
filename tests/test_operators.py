import pytest
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import evidence, html, registers, rules, units
from strata.sources import registers as S
from strata.streaming import sessions


def test_chunk_breaks_at_late_blank_lines_only():
    assert [len(c) for c in units.chunk_text("x" * 4000)] == [4000]
    assert [len(c) for c in units.chunk_text("x" * 4001)] == [4000, 1]
    early = "a" * 800 + "\n\n" + "b" * 4000
    assert len(units.chunk_text(early)[0]) == 4000
    late = "a" * 801 + "\n\n" + "b" * 4000
    assert len(units.chunk_text(late)[0]) == 801
    assert units.chunk_text(" \n ") == []
    assert [len(c) for c in units.chunk_text("\n " + "x" * 4001 + " ")] == [4000, 1]
    assert [len(c) for c in units.chunk_text("a" * 800 + "\n\n" + "b" * 5000)] == [4000, 1802]


@pytest.mark.parametrize(("a", "b", "want"), [(0, 0, "exact"), (10, 12, "close"), (10, 13, "both_present"), (100, 105, "close"), (100, 106, "both_present"), (0, 3, "target_only"), (3, 0, "source_only"), (0, 1, "target_only"), (-1, 1, "mismatch"), (None, None, "missing_signal"), (None, 1, "missing_signal")])
def test_relation(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a long, b long")
    assert df.select(T.relation(F.col("a"), F.col("b")).alias("r")).collect()[0]["r"] == want


def test_weak_quotes_and_urls(spark):
    rows = [("a" * 17, True), ("abcdefghijklmnopqr", False), ("abcabcabcabcabcabcabc", True), ("please subscribe to our letter", False), (" '\"국가법령정보센터 | 법령 국가법령정보센터 법령\" ", False), ("\"국가법령정보센터 |  법령 국가법령정보센터 법령\"", True), (None, True)]
    df = spark.createDataFrame(rows, "q string, w boolean")
    assert all(r["x"] == r["w"] for r in df.select("w", T.weak_quote(F.col("q")).alias("x")).collect())
    assert spark.sql("select 'https://a.example/' u").select(T.homepage_url(F.col("u"))).collect()[0][0]


def test_large_quote_tables_use_the_anchor_join(spark, monkeypatch):
    quotes = spark.createDataFrame([(1, "b c d e f g"), (2, "x y"), (3, "b c d e f z"), (4, ""), (5, None)], "k int, text string")
    texts = spark.createDataFrame([("a b c d e f g h",), ("w x y",), (None,), ("",)], "text string")
    small = {r[0] for r in evidence.supported(quotes, texts, "k").collect()}
    monkeypatch.setattr(evidence, "MOST_QUOTES", 1)
    assert {r[0] for r in evidence.supported(quotes, texts, "k").collect()} == small == {1, 2}


def test_difference_ignores_columns(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q"), (3, "z", None)], "id int, a string, phone string")
    b = spark.createDataFrame([(1, "x", "other"), (3, "z2", None), (4, "n", None)], "id int, a string, phone string")
    got = {r["id"]: (r["change"], r["columns"]) for r in registers.difference(a, b, "id", ("phone",)).collect()}
    assert got == {2: ("removed", ""), 3: ("changed", "a"), 4: ("added", "")}


@pytest.mark.parametrize("n", [0, 1, 2, 5, 10, 37])
def test_hash_split_is_a_partition(spark, n):
    got = registers.hash_split(spark.range(n).withColumnRenamed("id", "k"), "k").collect()
    assert len(got) == n
    assert sum(r["split"] == "discovery" for r in got) == round(0.7 * n)


def test_sequence_and_turns(spark):
    df = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("a", 2, True), ("b", 0, True), ("b", 2, True)], "k string, t int, done boolean")
    got = {r["k"]: r["gapless"] for r in rules.sequence_gaps(df, "k", "t").collect()}
    assert got == {"a": True, "b": False}
    assert [(r["k"], r["t"]) for r in rules.out_of_turn(df, "k", "t", "done").collect()] == [("a", 2)]


def test_html(spark):
    df = spark.createDataFrame([(1, "<p>a</p><script>x<p></script><P class=x>b &amp; c"), (2, None)], "page_id int, html string")
    got = {r["page_id"]: r for r in html.metrics(df).collect()}
    assert (got[1]["n_p"], got[1]["n_script"], got[2]["chars"]) == (3, 1, 0)
    assert [r[0] for r in df.select(html.stripped(F.col("html"))).collect()] == ["a b &amp; c", ""]


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿id,note\n1," a ""q""\nb "\n2,\n', encoding="utf-8")
    df = S.read_csv(spark, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'a "q"\nb'), ("2", "")]
    S.write_csv(df, str(tmp_path / "out"), ["id", "note"])
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "out")).orderBy("id").collect()] == [("1", 'a "q"\nb'), ("2", "")]


def test_markdown(spark):
    text = "# t\n| id | title |\n|---|---|\n| s1 | One |\n| bad |\n| s2 | Two |\n- **Status**: a\n- `status`: b\n## 2. Exact Quotes\n- q\n## 3. x\n"
    files = spark.createDataFrame([("f", text)], "path string, text string")
    rows = [{c["name"]: c["value"] for c in r["cells"]} for r in S.table_rows(files).orderBy("pos").collect()]
    assert rows == [{"id": "s1", "title": "One"}, {"id": "s2", "title": "Two"}]
    assert [(r["name"], r["value"]) for r in S.bullets(files).collect()] == [("status", "b")]
    assert files.select(S.section(F.col("text"), "Exact Quotes")).collect()[0][0].strip() == "- q"


def test_events_and_files(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"scope":"a","n":1}\nnot json\n{"scope":"b","n":2}\n')
    assert S.read_events(spark, str(tmp_path / "e.jsonl"), "scope string, n int").count() == 2
    found = S.files_by_hash(spark, str(tmp_path))
    assert found.count() == 1 and S.new_files(found, found).count() == 0


def test_sessions_on_a_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' ts, 1L user_id, 1.0D value union all select timestamp'2024-01-01 00:10:00', 1L, 2.0D union all select timestamp'2024-01-01 09:00:00', 1L, 3.0D").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(str(tmp_path / "in"))
    q = sessions.sessions(stream).writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["n_events"], r["total"]) for r in spark.table("sess").collect()] == [(2, 3.0)]


def test_compatible_texts_lose_white_space_only(spark):
    import unicodedata

    from strata.functions import korean

    texts = ["ｆｕｌｌ　width ①", "한 글\u00a0x", None, "", "ﬁ e\u0301\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert {r["k"]: r["plain"] for r in korean.compatible(df, "k", "t").collect()} == {i: "".join(c for c in unicodedata.normalize("NFKC", t or "") if not c.isspace()) for i, t in enumerate(texts)}


def test_greedy_cover_seeds_families_and_fills_up(spark):
    rows = [("a", 0, "x"), ("a", 0, "y"), ("b", 0, "x"), ("b", 0, "y"), ("b", 0, "z"), ("c", 1, "x"), ("d", 1, "w"), ("d", 1, "x"), ("e", 1, None)]
    df = spark.createDataFrame(rows, "k string, f int, feature string")
    assert registers.greedy_cover(df, "k", "feature", 10, family="f") == ["b", "d", "a", "c"]
    assert registers.greedy_cover(df, "k", "feature", 2) == ["b", "d"]
    assert registers.greedy_cover(df.limit(0), "k", "feature") == []


def test_cue_tokens_lose_endings_once(spark):
    import random
    import re

    from strata.functions import korean

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice(["가", "a", "9", "B", *korean.ENDINGS]) for _ in range(rng.randrange(1, 5))) for _ in range(30)) for _ in range(40)] + ["", None]

    def bare(t):
        for e in korean.ENDINGS:
            t = re.sub(f"^(.{{2,}}){e}$", r"\1", t)
        return t

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", korean.cue_tokens(F.col("t")).alias("c")).collect()
    for r in got:
        found = [bare(t) for t in re.findall("[0-9a-z가-힣]+", (texts[r["i"]] or "").lower())]
        assert r["c"] == list(dict.fromkeys(t for t in found if len(t) >= 2))
