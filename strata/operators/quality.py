"""Quality of sources and files: metadata against hosts, originals, PDFs, stubs, and what may be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import collapsed

#: Hosts of statute portals, words of statute titles, of other documents' titles and of other publishers.
LAW_HOSTS = ("law.go.kr", "www.law.go.kr")
LAW_TITLES = ("법", "법률", "시행령", "시행규칙", "규칙", "고시", "예규", "조례")
OTHER_TITLES = ("보도자료", "설명자료", "공약", "공약집", "정책공약", "실태조사", "조사 결과", "보고서", "백서", "가이드라인", "컨설팅", "자료집", "발표", "간담회")
OTHER_PUBLISHERS = ("금융위원회", "금감원", "금융감독원", "개인정보보호위원회", "국민의힘", "더불어민주당", "정책위원회")
#: What an id with a marker must be accompanied by.
ID_MARKERS = {
    "goldman": ("goldman",),
    "robinhood": ("robinhood", "sec", "10-k", "10k"),
    "samsung": ("samsung", "삼성", "bithumb", "빗썸"),
    "regulator": ("regulator", "agency", "authority", "감독기관", "규제기관", "실태조사"),
}
#: Words of summaries, marks of stub PDFs, the heading of a stub text.
SUMMARY_MARKERS = ("요약", "분석", "핵심 요지", "업무상 해석", "AI", "정리")
DUMMY_PDF_MARKERS = ("% Dummy PDF", "% Placeholder PDF", "% AI-generated", "research integrity verification", "Used for Benchmark")
STUB_HEADING = r"(?m)^\s*\[\s*[A-Z][A-Za-z0-9 ]{4,}\s*\]"
ARTICLE_MARKER = r"(?i)(제\d+조|Article\s+\d+|Form\s+10-K|SEC|regulator|agency|authority|위원회|부처|기관)"
#: Parts of column names that hold personal data.
PRIVATE_COLUMNS = ("phone", "email", "contact", "note", "notes", "비고", "연락처", "이메일")


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def metadata_mismatch(title: Column, publisher: Column, url: Column, law_hosts=LAW_HOSTS, law=LAW_TITLES, other=OTHER_TITLES, publishers=OTHER_PUBLISHERS) -> Column:
    """Why a source's title or publisher does not fit its statute portal's address; empty where it fits."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://([^/?#]*)", 1))
    at_portal, t, p = host.isin(*law_hosts), collapsed(title), collapsed(publisher)
    statute = any_of(t, law)
    return F.when(at_portal & ~statute & any_of(t, other), "title").when(at_portal & ~statute & any_of(p, publishers), "publisher").otherwise("")


def id_fits(key: Column, title: Column, path: Column, markers: dict[str, tuple[str, ...]] = ID_MARKERS) -> Column:
    """Whether an id that holds a marker comes with one of its words; the first marker in order decides."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)
    every = F.lower(F.concat_ws(" ", F.coalesce(key, F.lit("")), F.coalesce(title, F.lit("")), name))
    out, low = F.lit(True), F.lower(F.coalesce(key, F.lit("")))
    for marker, words in reversed(markers.items()):
        out = F.when(F.contains(low, F.lit(marker)), any_of(every, words)).otherwise(out)
    return out


def original_state(text: Column, markers: tuple[str, ...] = SUMMARY_MARKERS, article: str = ARTICLE_MARKER, head: int = 1200) -> Column:
    """What the beginning of a text says about its being an original: summary, note, original or unclear."""
    h = F.substring(F.coalesce(text, F.lit("")), 1, head)
    hits = sum((F.contains(h, F.lit(m)).cast("int") for m in markers), F.lit(0))
    linked = h.rlike("https?://")
    note = F.contains(h, F.lit("출처:")) & F.contains(h, F.lit(markers[0]))
    return F.when((hits >= 2) & ~linked, "summary").when(note & ~linked, "note").when(linked & h.rlike(article), "original").otherwise("unclear")


def pdf_state(content: Column, least: int = 4096, markers: tuple[str, ...] = DUMMY_PDF_MARKERS) -> Column:
    """ok, or why bytes are no genuine PDF: missing, small, a dummy's marker, or no PDF header and trailer."""
    head, out = F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), F.lit("ok")
    out = F.when(~head.startswith("%PDF-") | ~F.contains(F.decode(content, "ISO-8859-1"), F.lit("%%EOF")), "parse_error").otherwise(out)
    for m in reversed(markers):
        out = F.when(F.contains(head, F.lit(m)), F.concat(F.lit("dummy_marker: "), F.lit(m))).otherwise(out)
    return F.when(content.isNull(), "missing").when(F.octet_length(content) < least, "small").otherwise(out)


def stub_heading(text: Column, head: int = 300) -> Column:
    """Whether a bracketed heading stands within the first bytes of a text; a character cut by the bound is replaced."""
    raw = F.substring(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 1, head)
    return F.make_valid_utf8(raw.cast("string")).rlike(STUB_HEADING)


def file_originality(path: Column, there: Column, size: Column, text: Column, least: int = 1024) -> Column:
    """What a kept file's text says about its being an original, by the file first: missing, non_txt_original, received_too_small, then as ``original_state`` says."""
    small = path.rlike(r"(^|[/\\])received_originals[/\\]") & (size < least)
    return F.when(~F.coalesce(there, F.lit(False)), "missing").when(suffix(path) != "txt", "non_txt_original").when(small, "received_too_small").otherwise(original_state(text))


#: Suffixes that may leave the project, parts of paths that keep a file in it, and why.
SAFE_SUFFIXES = ("html", "json", "md", "csv", "xlsx", "xls", "tsv", "pdf", "docx")
ORIGINALS, SECRETS = ("received_originals", "preserved_originals"), (".env", "cookie", "secret", "token")
REASONS = ("preserved originals require separate explicit approval", "potential secret-like path", "file type is not in default cloud handoff allowlist")


def handoff(path: Column, suffixes: tuple[str, ...] = SAFE_SUFFIXES) -> Column:
    """(include, reason) of a file: left out as an original, as like a secret, which goes before, or for its suffix; empty reason where it may leave."""
    low = F.lower(F.coalesce(path, F.lit("")))
    why = F.when(any_of(low, SECRETS), REASONS[1]).when(any_of(low, ORIGINALS), REASONS[0]).when(suffix(path).isin(*suffixes), "").otherwise(REASONS[2])
    return F.struct((why == "").alias("include"), why.alias("reason"))


def without_private(df: DataFrame, parts: tuple[str, ...] = PRIVATE_COLUMNS) -> DataFrame:
    """The table without columns whose name holds one of the parts, in any case."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not any(p.lower() in c.lower() for p in parts)])


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./\\]+)$", 1))


def backing_data(path: Column, kinds: tuple[str, ...] = ("csv", "xlsx", "xls", "tsv"), except_for: str = "visual_plan.csv") -> Column:
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)
    return suffix(path).isin(*kinds) & (F.lower(name) != except_for)


def changed_path(line: Column) -> Column:
    """The path of a status line: what follows its three letters, the new name of a renamed file, with slashes."""
    path = F.replace(F.substring(line, 4, 1 << 30), F.lit("\\"), F.lit("/"))
    return F.when(F.contains(path, F.lit(" -> ")), F.regexp_replace(path, r"^.*? -> ", "")).otherwise(path)


def within(path: Column, roots: tuple[str, ...]) -> Column:
    """Whether a path is one of the roots or lies below one."""
    out = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        out = out | (path == r) | path.startswith(r + "/")
    return out


def evidence_paths(records: DataFrame, files: DataFrame, key: str, columns: list[str], path: str) -> DataFrame:
    """(key, n, path): the existing files that a record's columns name, in column order, each once."""
    named = records.select(key, F.posexplode(F.array(*columns)).alias("n", "_p")).filter(F.length("_p") > 0)
    named = named.groupBy(key, "_p").agg(F.min("n").alias("n"))
    return named.join(files.select(F.col(path).alias("_p")).distinct(), "_p", "left_semi").select(key, "n", F.col("_p").alias("path"))
