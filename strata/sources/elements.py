"""XML as rows: tokens, elements as intervals of tokens, and the blocks of a section with what is lost.

An element is the interval from its begin tag to its end tag in the order of tokens. Depth is a running sum,
tags meet their ends as neighbours on their level, and what lies in what is a containment join; no parser
runs. A document whose tags do not nest is malformed as a whole and has no elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import ranges

_TOKEN = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<[^<>]*>|[^<]+|<"
_REFERENCE = r"&#(x[0-9A-Fa-f]+|[0-9]+);"

#: Fixed values of the public format: drawn objects that stand in paragraphs, and objects that have no block.
DRAWN = ("container", "rect", "ellipse", "line", "polygon", "curve", "arc")
LOST = ("equation", "ole")


def repaired(c: Column) -> Column:
    """(text, n): numeric character references that XML does not allow become that of the replacement character; n of them were."""
    c = F.coalesce(c, F.lit(""))

    def bad(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^&#x?0*([0-9A-Fa-f]*);", 1)
        n = F.when(F.length(digits) <= 7, F.when(ref.startswith("&#x"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long"))
        ok = n.isin(9, 10, 13) | n.between(0x20, 0xD7FF) | n.between(0xE000, 0xFFFD) | n.between(0x10000, 0x10FFFF)
        return ~F.coalesce(ok, F.lit(False))

    refs = F.regexp_extract_all(c, F.lit(_REFERENCE), 0)
    parts = F.zip_with(F.split(c, _REFERENCE, -1), refs, lambda a, r: F.concat(a, F.when(r.isNull(), "").when(bad(r), "&#xFFFD;").otherwise(r)))
    return F.struct(F.array_join(parts, "").alias("text"), F.size(F.filter(refs, bad)).alias("n"))


def tokens(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, at, kind, tag, level, token): begin, end, empty, text and other tokens in order; level is the element's depth, for texts that of the element around it plus one."""
    t = df.select(key, F.posexplode(F.regexp_extract_all(xml, F.lit(_TOKEN), 0)).alias("at", "token"))
    c = F.col("token")
    kind = F.when(c.startswith("<!") | c.startswith("<?"), "other").when(c.startswith("</"), "end").when(c.startswith("<") & c.endswith("/>"), "empty").when(c.startswith("<"), "begin").otherwise("text")
    name = F.regexp_extract("token", r"^</?\s*(?:[^\s<>/:]+:)?([^\s<>/:]+)", 1)
    step = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0)
    run = F.sum(step).over(Window.partitionBy(key).orderBy("at"))
    t = t.withColumn("kind", kind).withColumn("_run", run)
    return t.select(key, F.col("at").cast("long").alias("at"), "kind", F.when(F.col("kind").isin("begin", "end", "empty"), name).alias("tag"), (F.col("_run") + F.when(F.col("kind") == "begin", 0).otherwise(1)).alias("level"), "token")


def elements(tokens: DataFrame, key: str) -> DataFrame:
    """(key, first, last, level, tag, fits) of every element: places of its tags; ``fits`` is false where a tag has no partner of its name."""
    tags = tokens.filter(F.col("kind").isin("begin", "end"))
    w = Window.partitionBy(key, "level").orderBy("at")
    t = tags.select("*", F.lead("kind").over(w).alias("_kind"), F.lead("tag").over(w).alias("_tag"), F.lead("at").over(w).alias("last"), F.lag("kind").over(w).alias("_before"))
    closed = (F.col("_kind") == "end") & (F.col("_tag") == F.col("tag"))
    begun = t.filter("kind = 'begin'").select(key, F.col("at").alias("first"), "last", "level", "tag", F.coalesce(closed, F.lit(False)).alias("fits"))
    stray = t.filter("kind = 'end' and not coalesce(_before = 'begin', false)").select(key, F.col("at").alias("first"), F.col("at").alias("last"), "level", "tag", F.lit(False).alias("fits"))
    empty = tokens.filter("kind = 'empty'").select(key, F.col("at").alias("first"), F.col("at").alias("last"), "level", "tag", F.lit(True).alias("fits"))
    return begun.unionByName(stray).unionByName(empty)


def section_blocks(tokens: DataFrame, elements: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, losses) of sections: (key, at, kind, anchor, text) and (key, loss, n).

    Below the root, a paragraph is a block with the text of its own runs, a table is a block, any other child is
    lost. A paragraph's objects follow it as blocks anchored to it: tables and pictures that stand in no
    paragraph or object within it, drawn objects likewise; a drawn object's pictures stand for it where it has any, unless
    it is a rectangle around a table. Equations and embedded objects are lost. A malformed document has no
    blocks and one loss, ``xml_parse_failed``.
    """
    broken = elements.filter("not fits").select(key).distinct()
    e = elements.join(broken, key, "left_anti")
    objects = ["tbl", "pic", *LOST, *DRAWN]
    tag = F.col("tag")
    top = e.filter("level = 2")
    heads = top.filter(tag.isin("p", "tbl")).select(key, F.col("first").alias("at"), F.when(tag == "p", "paragraph").otherwise("table").alias("kind"), F.lit(None).cast("long").alias("anchor"))
    lost = top.filter(~tag.isin("p", "tbl")).select(key, F.concat(F.lit("unsupported_section_child:"), tag).alias("loss"))
    # what holds an object: the innermost paragraph or object around it, and the outermost object below its paragraph
    bars = e.filter(tag.isin("p", *objects)).select(key, "first", "last", "level", F.col("tag").alias("_bar"))
    points = e.filter(tag.isin(*objects) & (F.col("level") > 2)).select(key, F.col("first").alias("at"), "last", "tag")
    inner = bars.withColumn("_from", F.col("first") + 1)  # an element does not hold itself
    held = ranges.within(points.select(key, "at", "tag"), inner.select(key, "_from", F.col("last").alias("_last"), "first", "level", "_bar"), key, "at", "_from", "_last")
    chain = held.groupBy(key, "at", "tag").agg(F.max("first").alias("around"), F.min(F.when(F.col("level") == 2, F.struct("first", "_bar"))).alias("_top"), F.collect_list(F.struct("first", "_bar")).alias("_chain"))
    chain = chain.filter("_top._bar = 'p'").select(key, "at", "tag", "around", F.col("_top.first").alias("anchor"), F.array_sort("_chain").alias("_chain"))
    direct = chain.filter(F.col("around") == F.col("anchor")).select(key, "at", "tag", "anchor")
    # below a direct object: its pictures at any depth, and whether a rectangle has a table
    below = chain.filter(F.size("_chain") > 1).select(key, "tag", "at", "anchor", F.col("_chain")[1]["first"].alias("_holder"))
    below = below.join(direct.select(key, F.col("at").alias("_holder"), F.col("tag").alias("_kind")), [key, "_holder"])
    has = below.groupBy(key, "_holder").agg(F.count_if(F.col("tag") == "pic").alias("_pics"), F.count_if(F.col("tag") == "tbl").alias("_tables"))
    d = direct.join(has.withColumnRenamed("_holder", "at"), [key, "at"], "left").na.fill(0, ["_pics", "_tables"])
    whole = tag.isin("tbl", "pic") | (F.col("_pics") == 0) | ((tag == "rect") & (F.col("_tables") > 0))
    shown = d.filter(whole).select(key, "at", "tag", "anchor")
    parts = d.filter(~whole).select(key, F.col("at").alias("_holder")).join(below.filter("tag = 'pic'"), [key, "_holder"]).select(key, "at", "tag", "anchor")
    every = shown.unionByName(parts)
    lost = lost.unionByName(every.filter(tag.isin(*LOST)).select(key, F.concat(F.lit("unsupported_object:"), tag).alias("loss")))
    kind = F.when(tag == "tbl", "table").when(tag == "pic", "picture").otherwise("drawing")
    bodies = every.filter(~tag.isin(*LOST)).select(key, "at", kind.alias("kind"), "anchor")
    # a text belongs to the innermost paragraph around it, if it stands in a text element of that paragraph
    around = e.filter(tag.isin("p", "t")).select(key, "first", "last", "level", F.col("tag").alias("_tag"))
    spots = tokens.filter("kind = 'text'").select(key, "at", "token")
    texts = ranges.nearest(spots, around, key, "at", "first", "last", {"_p": F.col("_tag") == "p", "_t": F.col("_tag") == "t"}).filter("_t > _p")
    plain = F.col("token")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    text = texts.groupBy(key, F.col("_p").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", plain.alias("x")))), lambda s: s["x"]), "").alias("text"))
    blocks = heads.unionByName(bodies).join(text, [key, "at"], "left").select(key, "at", "kind", "anchor", F.when(F.col("kind") == "paragraph", F.coalesce("text", F.lit(""))).alias("text"))
    losses = lost.unionByName(broken.select(key, F.lit("xml_parse_failed").alias("loss"))).groupBy(key, "loss").agg(F.count("*").alias("n"))
    return blocks, losses
