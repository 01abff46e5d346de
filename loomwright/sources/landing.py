"""Tables of raw answers of services, as they were landed: one answer in each row, read by JSON paths.

Fetching itself is left to the caller; what comes in is a folder of texts or a table with a text column. Defined results: a null answer and
one that isn't JSON give nulls or no rows; absent numbers count as 0 where that is said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.lab import at, number

# Metrics of the field record: (metric, name, good up to, fair up to). Fixed values.
RECORD = (
    ("lcp", "largest_contentful_paint", 2500, 4000), ("cls", "cumulative_layout_shift", 0.1, 0.25), ("fid", "first_input_delay", 100, 300), ("inp", "interaction_to_next_paint", 200, 500),
)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(file, answer) of a folder of JSON files, one whole answer each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("answer"))


def robots_files(spark: SparkSession, path: str) -> DataFrame:
    """(origin, status, content, content_type, content_length, final_url) of JSON lines; blank and malformed lines are left out."""
    schema = "origin string, status int, content string, content_type string, content_length bigint, final_url string, _bad string"
    d = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return d.filter("_bad is null and origin is not null").drop("_bad")


def sitemap_candidates(origins: DataFrame, statuses: DataFrame) -> DataFrame:
    """(origin, url) of each origin's first usual sitemap address that answered with success. statuses: (url, status)."""
    tries = F.array(*(F.struct(F.lit(i).alias("i"), F.concat("origin", F.lit(x)).alias("url")) for i, x in enumerate(("/sitemap.xml", "/sitemap_index.xml"))))
    d = origins.select("origin", F.explode(tries).alias("t")).select("origin", "t.i", "t.url").join(statuses.filter("status between 200 and 299").select("url").distinct(), "url", "left_semi")
    return d.groupBy("origin").agg(F.min_by("url", "i").alias("url"))


def both_strategies(desktop: DataFrame, mobile: DataFrame) -> DataFrame:
    """The answers of both strategies in one table."""
    return desktop.withColumn("strategy", F.lit("desktop")).unionByName(mobile.withColumn("strategy", F.lit("mobile")))


def record_metrics(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, metric, value, status) of field records; the 75th percentile as it is given, CLS not scaled. An absent metric is 0 and fail; a record without any gives none."""
    a = F.col(col)
    p = lambda k: number(a, "record", "metrics", k, "percentiles", "p75")
    rows = [F.struct(F.lit(m).alias("metric"), F.coalesce(p(k), F.lit(0.0)).alias("value"), F.when(p(k) <= good, "good").when(p(k) <= fair, "warn").otherwise("fail").alias("status")) for m, k, good, fair in RECORD]
    return df.filter(F.coalesce(*(p(k) for _, k, *_ in RECORD)).isNotNull()).select(id_col, F.explode(F.array(*rows)).alias("x")).select(id_col, "x.*")


def url_or_origin(urls: DataFrame, of_url: DataFrame, of_origin: DataFrame, col: str) -> DataFrame:
    """(url, answer, scope): the record of the address, else that of its origin, else null. of_url: (url, col), of_origin: (origin, col)."""
    from ..functions import urls as U

    d = urls.select("url", F.concat(F.lower(U.part(F.col("url"), 1)), F.lit("://"), F.lower(U.part(F.col("url"), 2))).alias("origin"))
    j = d.join(of_url.select("url", F.col(col).alias("_u")), "url", "left").join(of_origin.select("origin", F.col(col).alias("_o")), "origin", "left")
    return j.select("url", F.coalesce("_u", "_o").alias(col), F.when(F.col("_u").isNotNull(), "url").when(F.col("_o").isNotNull(), "origin").alias("scope"))


def search_rows(df: DataFrame, col: str, dimensions: list[str]) -> DataFrame:
    """The rows of paged search answers: a column for each dimension, clicks, impressions, ctr, position; the page of the rows doesn't matter."""
    rows = F.from_json(at(F.col(col), "rows"), "array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>")
    d = df.select(F.explode(rows).alias("r"))
    return d.select(*(F.get("r.keys", F.lit(i)).alias(k) for i, k in enumerate(dimensions)), F.col("r.clicks").cast("bigint").alias("clicks"), F.col("r.impressions").cast("bigint").alias("impressions"), "r.ctr", "r.position")


def inspections(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, verdict, coverage, indexed, declared, chosen, crawled_at, robots, fetch, rich_types) of index inspections; an answer without a result gives no row."""
    a = F.col(col)
    i = lambda k: at(a, "inspectionResult", "indexStatusResult", k)
    kinds = F.from_json(at(a, "inspectionResult", "richResultsResult", "detectedItems"), "array<struct<richResultType:string>>")
    return df.filter(at(a, "inspectionResult").isNotNull()).select(
        id_col, F.coalesce(i("verdict"), F.lit("NEUTRAL")).alias("verdict"), F.coalesce(i("coverageState"), F.lit("Unknown")).alias("coverage"), F.coalesce(i("verdict") == "PASS", F.lit(False)).alias("indexed"),
        i("userCanonical").alias("declared"), i("googleCanonical").alias("chosen"), F.try_to_timestamp(i("lastCrawlTime")).alias("crawled_at"), i("robotsTxtState").alias("robots"), i("pageFetchState").alias("fetch"), F.transform(kinds, lambda x: x["richResultType"]).alias("rich_types"),
    )


def listed_sitemaps(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, path, type, is_index, errors, warnings, submitted, indexed) of a property's sitemaps; absent numbers are 0."""
    one = "array<struct<path:string,type:string,isSitemapsIndex:boolean,errors:string,warnings:string,contents:array<struct<type:string,submitted:string,indexed:string>>>>"
    n = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint"))
    total = lambda f: F.aggregate(F.coalesce("s.contents", F.array().cast("array<struct<type:string,submitted:string,indexed:string>>")), F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x[f].try_cast("bigint"), F.lit(0).cast("bigint")))
    d = df.select(id_col, F.explode(F.from_json(at(F.col(col), "sitemap"), one)).alias("s"))
    return d.select(id_col, F.coalesce("s.path", F.lit("")).alias("path"), "s.type", F.coalesce("s.isSitemapsIndex", F.lit(False)).alias("is_index"), n("s.errors").alias("errors"), n("s.warnings").alias("warnings"), total("submitted").alias("submitted"), total("indexed").alias("indexed"))


def search_data(pages: DataFrame, search: DataFrame, inspection: DataFrame, sitemaps: DataFrame, id_col: str = "url") -> DataFrame:
    """Each page with its search totals, inspection and number of sitemaps; pages with neither totals nor an inspection are left out."""
    s = search.groupBy(id_col).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    m = sitemaps.groupBy(id_col).agg(F.count("*").alias("n_sitemaps"))
    j = pages.select(id_col).distinct().join(s, id_col, "left").join(inspection, id_col, "left").join(m, id_col, "left")
    return j.filter("impressions is not null or verdict is not null").na.fill(0, ["n_sitemaps"])


def request_headers(host: Column, common: dict[str, str], by_host: dict[str, dict[str, str]], given: dict[str, str]) -> Column:
    """A map of headers: those for all, over them the host's, over them the given ones."""
    as_map = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) if m else F.create_map().cast("map<string,string>")
    own = as_map({})
    for h, m in by_host.items():
        own = F.when(host == h, as_map(m)).otherwise(own)
    return F.map_zip_with(F.map_zip_with(as_map(common), own, lambda k, a, b: F.coalesce(b, a)), as_map(given), lambda k, a, b: F.coalesce(b, a))


def header_flags(flags: list[str]) -> dict[str, str]:
    """Headers of texts "Name: value"; a text without a name before its colon is left out."""
    pairs = (f.split(":", 1) for f in flags if f.find(":") >= 1)
    return {k.strip(): v.strip() for k, v in pairs}


def is_web_address(url: Column) -> Column:
    """Whether a text is an http or https address with a host."""
    return F.coalesce(F.trim(url).rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))
