"""Readers of crawl logs, run metadata, sitemaps and robots files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CRAWL = "url string, status int, title string, h1 string, canonical string, metaRobots string, isIndexable boolean, crawlDepth int, links array<struct<target:string,follow:boolean,type:string>>, _bad string"
META = "baseUrl string, crawledAt timestamp, sitemapUrls array<string>, errors map<string,string>, uncrawledReasons map<string,string>"


def crawl_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Crawl records of a JSON lines file or folder; blank and malformed lines are left out, the fields named as in the tables."""
    d = spark.read.schema(CRAWL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    d = d.filter("_bad is null and url is not null")
    return d.select("url", "status", "title", "h1", "canonical", F.col("metaRobots").alias("meta_robots"), F.col("isIndexable").alias("is_indexable"), F.col("crawlDepth").alias("crawl_depth"), F.transform("links", lambda x: F.struct(x["target"].alias("target"), x["follow"].alias("follow"), x["type"].alias("link_type"))).alias("links"))


def crawl_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).option("multiLine", True).json(path)


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(file, loc, lastmod, is_index) of sitemap files; dates that can't be read are null."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    e = t.select("file", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<(?:url|sitemap)>.*?</(?:url|sitemap)>"), F.lit(0))).alias("x"))
    return e.select("file", F.trim(F.regexp_extract("x", r"<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>", 1)).alias("loc"), F.expr("try_to_timestamp(regexp_extract(x, '<lastmod>\\\\s*(.*?)\\\\s*</lastmod>', 1))").alias("lastmod"), F.col("x").startswith("<sitemap>").alias("is_index"))


def latest_run(spark: SparkSession, root: str, host: str) -> DataFrame:
    """The newest run of a host in a folder partitioned by host and run_ts (both pruned)."""
    d = spark.read.parquet(root).filter(F.col("host") == host)
    return d.join(F.broadcast(d.agg(F.max("run_ts").alias("run_ts"))), "run_ts", "left_semi")  # one row


def run_host(host: str) -> str:
    """A host as it names a run's folder: dots become underscores."""
    return host.replace(".", "_")


def find_run(spark: SparkSession, root: str, host: str, override: str | None = None) -> DataFrame:
    """The newest run of a host, or the one named by override."""
    d = spark.read.parquet(root).filter(F.col("host").isin(host, run_host(host)))
    return d.filter(F.col("run_ts") == override) if override is not None else d.join(F.broadcast(d.agg(F.max("run_ts").alias("run_ts"))), "run_ts", "left_semi")  # one row


def newest_run(spark: SparkSession, root: str) -> DataFrame:
    """The newest run of all hosts; of equally new ones the first host's."""
    d = spark.read.parquet(root)
    best = d.agg(F.max("run_ts").alias("run_ts"))
    newest = d.join(F.broadcast(best), "run_ts", "left_semi")  # one row
    return newest.join(F.broadcast(newest.agg(F.min("host").alias("host"))), "host", "left_semi")  # one row


def followed_sitemaps(files: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """(loc, lastmod) of a sitemap and of the sitemaps that it names, `depth` levels down; files: (file, loc, lastmod, is_index) as `sitemap` gives them.

    Only addresses of the start's host count, with or without www.
    """
    from ..functions.urls import host

    own = lambda c: F.regexp_replace(host(c), r"^www\.", "") == F.regexp_replace(host(F.lit(start)), r"^www\.", "")
    level, out = files.filter(F.col("file") == start), None
    for _ in range(depth + 1):
        pages = level.filter(~F.col("is_index") & own(F.col("loc"))).select("loc", "lastmod")
        out = pages if out is None else out.unionByName(pages)
        level = files.join(level.filter(F.col("is_index") & own(F.col("loc"))).select(F.col("loc").alias("file")).distinct(), "file", "left_semi")
    return out.distinct()


def config(spark: SparkSession, key: str, override: str | None = None, default: str | None = None) -> str | None:
    """An option by its order: override, session, default."""
    return override if override is not None else spark.conf.get(key, default)
