"""Line grammar of markdown: code fences by parity, blocks of quotes and lists as islands, tables, links and anchors.

Windows run over the lines of one text, so a text is the largest group. Null and empty texts have no lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.urls import host

GENERIC = ("click here", "here", "read more", "learn more", "more", "this", "link", "see more", "details")  # fixed values


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line, in_code, kind, state): state is the last line before that opened or closed a block."""
    d = df.filter(F.length(text_col) > 0).select(id_col, F.posexplode(F.split(text_col, r"\r\n|\n|\r")).alias("pos", "line"))
    w = Window.partitionBy(id_col).orderBy("pos")
    fence = F.col("line").rlike(r"^\s*```")
    d = d.withColumn("fence", fence).withColumn("in_code", (F.sum(fence.cast("int")).over(w) % 2 == 1) | fence)
    kind = (
        F.when(F.col("fence"), "fence").when(F.col("in_code"), "code").when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"^#{1,6}\s"), "heading").when(F.col("line").rlike(r"^>"), "quote")
        .when(F.col("line").rlike(r"^\s*[-*+]\s"), "unordered").when(F.col("line").rlike(r"^\s*\d+[.)]\s"), "ordered").when(F.col("line").rlike(r"^\|"), "table").otherwise("text")
    )
    d = d.withColumn("kind", kind)
    state = F.last(F.when(~F.col("kind").isin("text", "code"), F.col("kind")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("state", F.coalesce(state, F.lit("blank")))


def structure(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Counts of headings, code blocks, quotes, lists, items, tables and table rows of each text."""
    d = lines(df, id_col, text_col)
    k, s = F.col("kind"), F.col("state")
    starts = lambda x: F.count_if((k == x) & (s != x))
    return d.groupBy(id_col).agg(
        F.count_if(k == "heading").alias("headings"),
        (F.count_if(k == "fence") / 2).cast("bigint").alias("code_blocks"),
        starts("quote").alias("quote_blocks"),
        starts("unordered").alias("unordered_lists"),
        starts("ordered").alias("ordered_lists"),
        F.count_if(k.isin("unordered", "ordered")).alias("items"),
        starts("table").alias("tables"),
        F.count_if((k == "table") & ~F.col("line").rlike(r"^[|\s:-]+$")).alias("table_rows"),
    )


def heading_skips(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, from_level, to_level) of headings that go down by more than one level."""
    h = lines(df, id_col, text_col).filter("kind = 'heading'").select(id_col, "pos", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("to_level"))
    w = Window.partitionBy(id_col).orderBy("pos")
    return h.withColumn("from_level", F.lag("to_level").over(w)).filter("to_level > from_level + 1").select(id_col, "pos", "from_level", "to_level")


def links(df: DataFrame, id_col: str, text_col: str, url_col: str) -> DataFrame:
    """(id, anchor, target, internal, anchor_class) of each link that isn't an image."""
    found = F.filter(F.split(F.regexp_replace(text_col, r"!\[", "["), r"(?=\[[^\[\]]*\]\()"), lambda x: x.rlike(r"^\[[^\[\]]*\]\([^)\s]+\)"))
    images = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"!\[[^\[\]]*\]\(([^)\s]+)\)"), F.lit(1))
    d = df.select(id_col, F.col(url_col).alias("_u"), images.alias("_i"), F.explode(found).alias("x"))
    d = d.select(id_col, "_u", "_i", F.regexp_extract("x", r"^\[([^\[\]]*)\]", 1).alias("anchor"), F.regexp_extract("x", r"^\[[^\[\]]*\]\(([^)\s]+)\)", 1).alias("target")).filter("not array_contains(_i, target)")
    a = F.lower(F.trim("anchor"))
    cls = F.when(a == "", "empty").when(a.rlike(r"^(https?://|www\.)"), "naked").when(a.isin(*GENERIC), "generic").when(F.size(F.split(a, r"\s+")) >= 2, "descriptive").otherwise("partial")
    internal = F.col("target").rlike("^[/#?]") | (host(F.col("target")) == host(F.col("_u")))
    return d.select(id_col, "anchor", "target", internal.alias("internal"), cls.alias("anchor_class"))
