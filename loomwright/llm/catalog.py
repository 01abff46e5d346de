"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import dedup, encode, garbled, language, lines, mix, pages
from ..session import Query, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = dedup.copies(table(spark, d, "crawl_pages"), "page_id", ["url", "canonical"])
    return pairs.filter("rep <> id").select(F.col("rep").alias("page_id_a"), F.col("id").alias("page_id_b"))


def p2_copies(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copy_counts(table(spark, d, "crawl_pages"), "page_id", ["url", "canonical"]).select(F.col("rep").alias("page_id"), "n_copies")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.keyword_spam(table(spark, d, "page_splits"), table(spark, d, "page_runs")).filter("is_spam").select("run_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.residue_pages(table(spark, d, "page_splits"), table(spark, d, "page_runs")).select("run_id")


def p4_remaining(spark: SparkSession, d: str) -> DataFrame:
    """The runs that remain without those of p4_found."""
    return table(spark, d, "page_runs").select("run_id").filter("run_id is not null").distinct().join(p4_found(spark, d), "run_id", "left_anti")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_languages(table(spark, d, "page_splits"), table(spark, d, "page_runs"), table(spark, d, "content_analysis"))


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of every page that p5_found judges, whatever its label: (run_id, lang, confidence, ambiguous, mixed)."""
    return language.document_languages(language.page_segments(table(spark, d, "page_splits"), table(spark, d, "page_runs"), table(spark, d, "content_analysis")), "run_id")


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """The language of every block of running text of those pages, with its confidence."""
    return language.page_segments(table(spark, d, "page_splits"), table(spark, d, "page_runs"), table(spark, d, "content_analysis"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.body_blocks(table(spark, d, "page_splits"), table(spark, d, "page_runs"))


def p6_main_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of every page's body, of its html where it has no markdown."""
    return pages.main_text(table(spark, d, "page_splits"), table(spark, d, "page_runs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = lines.repeated_lines(table(spark, d, "crawl_pages"), "page_id", "host", "raw_html")
    return found.select(F.col("id").alias("page_id"), "line_no")


def p7_without(spark: SparkSession, d: str) -> DataFrame:
    """Every raw_html without the lines of p7_found; null stays null."""
    crawl = table(spark, d, "crawl_pages")
    found = lines.repeated_lines(crawl, "page_id", "host", "raw_html")
    return lines.without_lines(crawl, found, "page_id", "raw_html", "raw_html").withColumnRenamed("id", "page_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Encoding and decoding again: the texts as they were, '' for null."""
    return encode.decode(p8_ids(spark, d), "doc_id")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture's blocks with their token ids and documents."""
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the sources reached."""
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restored(table(spark, d, "documents")).select(F.col("id").alias("doc_id"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with what could be restored of their texts."""
    return garbled.restored(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), "restored_text")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_copies, p3_found, p4_found, p4_remaining, p5_found, p5_languages, p5_segments, p6_found, p6_main_text, p7_found, p7_without, p8_ids, p8_decoded, p9_mixture, p9_shares, p10_found, p10_restored)}

_NORM = "regexp_replace(lower(url_decode(regexp_replace({x}, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)', '\\1', 'g'))), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"


def _key(f: str) -> str:
    n = lambda x: _NORM.format(x=x)
    head, query = f"split_part({f}, '?', 1)", f"split_part(substr({f}, length(split_part({f}, '?', 1)) + 2), '#', 1)"
    params = f"list_sort(list_filter(list_transform(regexp_split_to_array({query}, '[&;]'), lambda p: {n('split_part(p, chr(61), 1)')} || '=' || {n('substr(p, length(split_part(p, chr(61), 1)) + 2)')}), lambda q: q <> '='))"
    return f"CASE WHEN {f} IS NULL THEN NULL ELSE {n(head)} || '|' || array_to_string({params}, '&') END"


_P2 = f"SELECT page_id, {_key('url')} AS u, {_key('canonical')} AS c FROM crawl_pages"

SQL: dict[str, str] = {
    "p2_found": f"WITH k AS ({_P2}), g AS (SELECT u, c, min(page_id) AS a FROM k GROUP BY u, c) SELECT g.a AS page_id_a, k.page_id AS page_id_b FROM k JOIN g ON k.u IS NOT DISTINCT FROM g.u AND k.c IS NOT DISTINCT FROM g.c WHERE k.page_id <> g.a",
    "p2_copies": f"WITH k AS ({_P2}) SELECT min(page_id) AS page_id, count(*)::BIGINT AS n_copies FROM k GROUP BY u, c",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
