import io
import struct
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import blocks, linking, nested, ordering
from strata.sources import containers as C


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in parts:
            z.writestr(n, b)
    return out.getvalue()


def _compound(name: str, body: bytes) -> bytes:
    """A compound file of one stream that is long enough to lie in ordinary sectors."""
    n = -(-len(body) // 512)
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [i + 3 for i in range(n - 1)] + [0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))
    head = bytes.fromhex(C.MAGIC["compound"]) + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)

    def node(label, kind, child, start, size):
        raw = label.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + bytes(36) + struct.pack("<IQ", start, size)

    directory = node("Root Entry", 5, 1, 0xFFFFFFFE, 0) + node(name, 2, 0xFFFFFFFF, 2, len(body)) + bytes(256)
    return head + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108) + struct.pack("<128I", *fat) + directory + body.ljust(n * 512, b"\0")


def test_zip_packages(spark):
    good = _zip([("mimetype", b"a/b"), ("x/one.xml", b'<r xmlns="u" a="1"><c>t</c><c b="2"/></r>'), ("two.xml", b"<r>"), ("../up.xml", b"<r/>")])
    df = spark.createDataFrame([("g", bytearray(good)), ("bad", bytearray(b"PK\x03\x04zz")), ("none", None)], "path string, content binary")
    assert {r["path"]: r["k"] for r in df.select("path", C.kind(F.col("content")).alias("k")).collect()} == {"g": "zip", "bad": "zip", "none": None}
    entries = C.zip_entries(df).cache()
    assert {(r["path"], r["entry"], r["status"]) for r in entries.collect()} == {("g", "mimetype", "ok"), ("g", "x/one.xml", "ok"), ("g", "two.xml", "ok"), ("g", "../up.xml", "unsafe_name"), ("bad", None, "not_a_zip"), ("none", None, "not_a_zip")}
    found = C.xml_elements(entries).orderBy("entry", "pos").collect()
    assert [(r["tag"], r["parent"], r["depth"], r["attrs"], r["text"], r["status"]) for r in found] == [(None, None, 0, None, None, "damaged"), ("r", None, 0, {"a": "1"}, "", "ok"), ("c", 0, 1, {}, "t", "ok"), ("c", 0, 1, {"b": "2"}, "", "ok")]
    checks = {(r["path"], r["check"]): r["passed"] for r in C.package_checks(entries, ["x/one.xml"], "a/b").collect()}
    assert checks["g", "has:x/one.xml"] and checks["g", "mimetype"] and not checks["g", "unsafe_name"] and not checks["bad", "not_a_zip"]
    assert [r["status"] for r in C.zip_entries(df.filter("path = 'g'"), entries=2).collect()] == ["too_large"]
    entries.unpersist()


def _record(tag, level, body):
    n = len(body)
    return struct.pack("<I", tag | level << 10 | min(n, 0xFFF) << 20) + (struct.pack("<I", n) if n >= 0xFFF else b"") + body


def test_compound_streams_and_records(spark):
    raw = _record(66, 0, b"ab") + _record(67, 1, b"c" * 5000) + _record(68, 2, b"xyz")[:-1]
    c = zlib.compressobj(0, zlib.DEFLATED, -15)
    packed = c.compress(raw) + c.flush()
    broken = bytearray(_compound("S", packed))
    broken[512 + 8 : 512 + 12] = struct.pack("<I", 2)  # the stream's first sector leads to itself
    df = spark.createDataFrame([("f", bytearray(_compound("Body", packed))), ("loop", broken), ("no", bytearray(b"x"))], "path string, content binary")
    streams = C.compound_streams(df).cache()
    assert {(r["path"], r["stream"], r["status"]) for r in streams.collect()} == {("f", "Body", "ok"), ("loop", "S", "damaged"), ("no", None, "not_compound")}
    got = C.tagged_records(streams.filter("status = 'ok'")).orderBy("idx").collect()
    assert [(r["tag"], r["level"], r["size"], r["status"]) for r in got] == [(66, 0, 2, "ok"), (67, 1, 5000, "ok"), (68, 2, 3, "truncated_body")]
    streams.unpersist()
    assert C.inflate(zlib.compress(b"q" * 99)) == (b"q" * 99, "ok")
    assert C.inflate(zlib.compress(b"q" * 99), 10)[1] == "too_large"


def test_blocks(spark):
    page = '<h2>A &amp; B</h2><p>one<br>two<script>x<p></script></p><ul><li>i</li></ul><img alt="pic"><p> </p>'
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [(r["kind"], r["level"], r["text"]) for r in blocks.html_blocks(df).orderBy("pos").collect()] == [("heading", 2, "A & B"), ("paragraph", 0, "one two"), ("list_item", 0, "i"), ("image", 0, "pic")]
    assert {r["page_id"]: r["body"] for r in blocks.html_parsed(df).collect()} == {1: "A & B one two i", 2: ""}
    assert "x<p>" in blocks.parse(page, hidden=True)[1]


def test_ordering_edges(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("b", 1, None)], "k string, o int, v string")
    assert [r["v"] for r in ordering.forward_fill(df, "k", "o", "v").orderBy("k", "o").collect()] == [None, "x", "x", None]
    assert {r["k"]: r["items"] for r in ordering.padded(df.fillna("-"), "k", "o", "v", 2, "none").collect()} == {"a": ["-", "x"], "b": ["-", "none"]}
    assert ordering.rescale(df.limit(0).withColumn("n", F.lit(1.0)), "k", "n", 2.0).count() == 0


def test_closure_and_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 12)] + [(0, None)], "c int, p int")
    got = linking.closure(chain, "c", "p").collect()
    assert len(got) == 66 and all(r["node"] - r["ancestor"] == r["depth"] for r in got)
    with pytest.raises(ValueError, match="cycle"):
        linking.closure(spark.createDataFrame([(1, 2), (2, 1)], "c int, p int"), "c", "p", most=4)


def test_leaves_and_shingles(spark):
    df = spark.sql("select 1 as k, named_struct('a', 1, 'b', array(named_struct('c', 'x'), named_struct('c', 'y')), 'e', cast(null as array<int>)) as v")
    assert {(r["path"], r["value"]) for r in nested.leaves(df, "k", "v").collect()} == {("$.a", "1"), ("$.b[0].c", "x"), ("$.b[1].c", "y")}
    t = spark.createDataFrame([(" a b  c d",), ("a b",), (None,)], "t string")
    assert [r[0] for r in t.select(T.shingles(F.col("t"), 3)).collect()][:2] == [["a b c", "b c d"], []]


def test_first_holder_has_two_ways(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "b c d e f"), (3, "x b c d e f y"), (4, None), (5, "")], "p int, t string")
    quotes = spark.createDataFrame([(1, "b c d e f"), (2, "a b c d e"), (3, "a b"), (4, "b c d e z"), (5, None)], "k int, q string")
    runs = T.shingles(F.col("q"), 3)
    find = lambda: {r["k"]: (r["how"], r["place"]) for r in linking.first_holder(quotes, texts, "k", "q", "p", "t", F.when(F.size(runs) >= 3, runs[1]), T.shingles(F.col("t"), 3)).collect()}
    small = find()
    monkeypatch.setattr(linking, "MOST_QUOTES", 0)
    assert find() == small == {1: ("equal", 2), 2: ("within", 1), 3: ("none", None), 4: ("none", None), 5: ("none", None)}


def test_every_document_is_looked_up(spark):
    from oracle import SF

    from strata.plans import catalogue

    got = {r["item_id"]: (r["how"], r["place"]) for r in catalogue.queries()["lookup_every"](spark, SF).collect()}
    docs = catalogue.read(spark, SF, "documents").select("doc_id", "text").collect()
    first = {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    assert len(docs) > 50 and all(got[100000 + r["doc_id"]] == ("equal", first[r["text"]]) for r in docs if r["text"] is not None)


def test_quotes_without_an_anchor_are_found_within_texts(spark, monkeypatch):
    texts = spark.createDataFrame([(3, "x a b y"), (1, "a b c d e f"), (2, "c d"), (4, None)], "p int, t string")
    quotes = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "b y"), (4, "q"), (5, None), (6, "a b"), (7, "b c d e f")], "k int, q string")
    runs = T.shingles(F.col("q"), 3)
    find = lambda: {r["k"]: (r["how"], r["place"]) for r in linking.first_holder(quotes, texts, "k", "q", "p", "t", F.when(F.size(runs) >= 3, runs[1]), T.shingles(F.col("t"), 3), unanchored=True).collect()}
    small = find()
    monkeypatch.setattr(linking, "MOST_QUOTES", 2)
    blocks = find()
    assert small == blocks == {1: ("within", 1), 2: ("equal", 2), 3: ("within", 3), 4: ("none", None), 5: ("none", None), 6: ("within", 1), 7: ("within", 1)}


def test_records_of_many_streams_are_sent_together(spark):
    class Given:
        """Stands for a table: gives back the function that its batches would go through."""

        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            return f

    stream = struct.pack("<I", 66 | 3 << 20) + b"abc"
    names = ["path", "stream", "bytes"]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(15000)]), pa.array(["s"] * 15000), pa.array([stream, stream * 2, None] * 5000, pa.binary())], names=names)
    got = list(C.tagged_records(Given(), packed=False)([batch]))
    assert [b.num_rows for b in got] == [10000, 5000]
    assert pa.concat_arrays([b.column("body") for b in got]).to_pylist() == [b"abc"] * 15000
    long = struct.pack("<II", 66 | 0xFFF << 20, 3 << 20) + b"z" * (3 << 20)
    batch = pa.RecordBatch.from_arrays([pa.array(list("abc")), pa.array(["s"] * 3), pa.array([long] * 3, pa.binary())], names=names)
    assert [b.num_rows for b in C.tagged_records(Given(), packed=False)([batch])] == [2, 1]
