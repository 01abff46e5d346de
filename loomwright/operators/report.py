"""The merged report of a page and its issue rules: one row for each rule that holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# (code, severity, predicate over the merged row). Fixed values of thresholds.
RULES = (
    ("http_error", "critical", "status between 400 and 599"),
    ("unreachable", "critical", "status = 0"),
    ("not_indexable", "critical", "is_indexable = false"),
    ("title_missing", "critical", "coalesce(title, '') = ''"),
    ("not_https", "critical", "not https"),
    ("interactive_late", "critical", "tti_s > 10"),
    ("thin_high", "critical", "thin_content_risk = 'high'"),
    ("description_missing", "warning", "coalesce(description, '') = ''"),
    ("lcp_poor", "warning", "field_lcp > 4000"),
    ("cls_poor", "warning", "field_cls > 0.25"),
    ("inp_poor", "warning", "field_inp > 500"),
    ("cls_poor_lab", "warning", "not has_field and lab_cls > 0.25"),
    ("performance_low", "warning", "not has_field and performance_score < 50"),
    ("blocking_time", "warning", "tbt_ms > 300"),
    ("ttfb_slow", "warning", "ttfb_ms > 600"),
    ("h1_missing", "warning", "h1_count = 0"),
    ("sitemap_missing", "warning", "n_sitemaps = 0"),
    ("img_alt_missing", "warning", "images_without_alt > 0"),
    ("unnamed_controls", "warning", "links_without_text + buttons_without_text > 0"),
    ("inputs_unlabelled", "warning", "n_unlabelled > 0"),
    ("render_blocking", "warning", "render_blocking in ('warn', 'fail')"),
    ("over_linked", "warning", "over_linked"),
    ("duplicate_ids", "warning", "repeated_ids > 0"),
    ("inline_handlers", "warning", "inline_handlers > 0"),
    ("heading_skip", "warning", "n_skips > 0"),
    ("empty_headings", "warning", "empty_headings > 0"),
    ("multiple_h1", "warning", "h1_count > 1"),
    ("many_tags", "warning", "tag_manager and n_third_party > 15"),
    ("redirect_long", "warning", "n_redirects > 2"),
    ("low_word_count", "info", "word_count > 0 and word_count < 300"),
    ("div_heavy", "info", "div_ratio > 0.7"),
    ("canonical_missing", "info", "coalesce(canonical, '') = ''"),
    ("no_structured_data", "info", "coalesce(jsonld_scripts, 0) = 0"),
    ("no_permissions_policy", "info", "has_headers and not has_permissions_policy"),
    ("img_dimensions", "info", "images_without_size > 0"),
    ("inline_styles", "info", "inline_styles > 100"),
    ("no_published_time", "info", "coalesce(published_time, '') = '' and word_count > 500"),
    ("few_modern_images", "info", "images > 0 and images_modern / images < 0.5"),
    ("empty_elements", "info", "empty_elements > 300"),
    ("third_party", "info", "n_third_party > 10 and not (tag_manager and n_third_party > 15)"),
    ("no_cache_control", "info", "has_headers and cache_control is null"),
    ("no_preconnect", "info", "preconnect = 0 and n_third_party > 3"),
)
# Columns of the lab and field figures, of the robots file and of links, with what counts where they are absent.
ABSENT = {
    "tti_s": "cast(null as double)", "tbt_ms": "cast(null as double)", "lab_cls": "cast(null as double)", "performance_score": "cast(null as bigint)", "field_lcp": "cast(null as double)", "field_cls": "cast(null as double)",
    "field_inp": "cast(null as double)", "has_field": "false", "n_sitemaps": "0", "render_blocking": "cast(null as string)", "over_linked": "false",
}


def merged(runs: DataFrame, summary: DataFrame, meta: DataFrame, analysis: DataFrame, audit: DataFrame | None = None, scripts: DataFrame | None = None, figures: DataFrame | None = None) -> DataFrame:
    """One row for each run; what is missing stays null (left joins, never inner).

    audit: (run_id, n_unlabelled, n_skips). scripts: (run_id, domain, tag_manager) of third parties. figures: (run_id and any
    of the columns of ABSENT); those it lacks count as absent.
    """
    a = analysis.groupBy("run_id").agg(F.max("word_count").alias("word_count"), F.max("thin_content_risk").alias("thin_content_risk"))
    h = F.transform_keys("headers", lambda k, v: F.lower(k))
    https = F.lower("url").startswith("https://") | F.exists(F.coalesce("redirect_chain", F.array().cast("array<string>")), lambda x: F.lower(x).startswith("https://"))
    r = runs.select(
        "run_id", "url", "status", "ttfb_ms", "cdn", "compression", F.coalesce(F.size("redirect_chain"), F.lit(0)).alias("n_redirects"), https.alias("https"), F.col("headers").isNotNull().alias("has_headers"),
        F.try_element_at(h, F.lit("cache-control")).alias("cache_control"), F.coalesce(F.map_contains_key(h, "permissions-policy"), F.lit(False)).alias("has_permissions_policy"),
    )
    out = r.join(summary, "run_id", "left").join(meta.withColumn("is_indexable", F.col("index")), "run_id", "left").join(a, "run_id", "left")
    out = out.join(audit, "run_id", "left") if audit is not None else out.withColumns({"n_unlabelled": F.lit(None).cast("bigint"), "n_skips": F.lit(None).cast("bigint")})
    if scripts is not None:
        out = out.join(scripts.groupBy("run_id").agg(F.count_distinct("domain").alias("n_third_party"), F.max("tag_manager").alias("tag_manager")), "run_id", "left")
    else:
        out = out.withColumns({"n_third_party": F.lit(None).cast("bigint"), "tag_manager": F.lit(None).cast("boolean")})
    out = out.withColumns({"n_third_party": F.coalesce("n_third_party", F.lit(0)), "tag_manager": F.coalesce("tag_manager", F.lit(False))})
    if figures is not None:
        out = out.join(figures, "run_id", "left")
    for c, default in ABSENT.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.expr(default)) if figures is not None and c in figures.columns else F.expr(default))
    return out


def search_issues(page: DataFrame, search: DataFrame, inspection: DataFrame) -> DataFrame:
    """(url, severity, code) from search data: not indexed, another canonical than the declared one, few clicks for many views.

    search: (url, clicks, impressions). inspection: (url, verdict, indexed, declared, chosen).
    """
    s = search.groupBy("url").agg(F.sum("clicks").alias("c"), F.sum("impressions").alias("i"))
    j = page.select("url").distinct().join(s, "url", "left").join(inspection, "url", "left")
    hit = F.array(
        F.when((F.col("verdict") == "FAIL") | ~F.col("indexed"), F.struct(F.lit("critical").alias("severity"), F.lit("not_indexed").alias("code"))),
        F.when((F.col("declared") != F.col("chosen")), F.struct(F.lit("warning").alias("severity"), F.lit("other_canonical").alias("code"))),
        F.when((F.col("i") > 100) & (F.try_divide(F.col("c"), F.col("i")) < 0.02), F.struct(F.lit("warning").alias("severity"), F.lit("few_clicks").alias("code"))),
    )
    return j.select("url", F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("x")).select("url", "x.*")


def front_matter(issue_df: DataFrame, page: DataFrame, id_col: str = "run_id") -> DataFrame:
    """(id, status, cdn, n_critical, n_warning, n_info): the head of each page's report, pages without an issue too; no delivery network is none."""
    n = issue_df.groupBy(id_col).agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("critical", "warning", "info")))
    return page.select(id_col, "status", F.coalesce("cdn", F.lit("none")).alias("cdn")).join(n, id_col, "left").na.fill(0, ["n_critical", "n_warning", "n_info"])


def issues(page: DataFrame, id_col: str = "run_id") -> DataFrame:
    """(id, severity, code) of each rule that holds; a rule over a null holds not."""
    hit = F.array(*(F.when(F.expr(p), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for c, s, p in RULES))
    return page.select(id_col, F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("x")).select(id_col, "x.severity", "x.code")


def dedupe_issues(issue_df: DataFrame) -> DataFrame:
    return issue_df.groupBy("severity", "code").agg(F.count("*").alias("n"))


SECURITY = ("strict-transport-security", "content-security-policy", "x-content-type-options", "x-frame-options", "referrer-policy", "permissions-policy")


def security_headers(runs: DataFrame) -> DataFrame:
    """(run_id, n_present, grade, missing) of the six headers."""
    h = F.transform(F.map_keys("headers"), lambda k: F.lower(k))
    n = F.size(F.array_intersect(h, F.array(*map(F.lit, SECURITY))))
    return runs.filter("headers is not null").select("run_id", n.cast("bigint").alias("n_present"), F.when(n >= 5, "good").when(n >= 3, "moderate").otherwise("poor").alias("grade"), F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, SECURITY)), h)), ",").alias("missing"))


def caching(runs: DataFrame) -> DataFrame:
    """(run_id, has_cache_control, max_age, no_store, short_ttl)."""
    cc = F.lower(F.try_element_at(F.transform_keys("headers", lambda k, v: F.lower(k)), F.lit("cache-control")))
    age = F.expr("try_cast(nullif(regexp_extract(cc, 'max-age=(\\\\d+)', 1), '') as bigint)")
    return runs.filter("headers is not null").select("run_id", cc.alias("cc")).select("run_id", F.col("cc").isNotNull().alias("has_cache_control"), age.alias("max_age"), F.coalesce(F.col("cc").contains("no-store"), F.lit(False)).alias("no_store"), F.coalesce(age < 300, F.lit(False)).alias("short_ttl"))


def detect_compression(runs: DataFrame) -> DataFrame:
    e = F.lower(F.try_element_at(F.transform_keys("headers", lambda k, v: F.lower(k)), F.lit("content-encoding")))
    return runs.select("run_id", F.when(e.contains("br"), "br").when(e.contains("gzip"), "gzip").when(e.contains("deflate"), "deflate").alias("compression_seen"))


# Delivery networks: (name, part, whether only names of headers count), first match wins. Fixed values.
CDN = (
    ("cloudflare", "cf-ray", False), ("cloudflare", "cf-cache-status", False), ("cloudfront", "x-amz-cloudfront-id", False), ("cloudfront", "cloudfront", False),
    ("akamai", "akamai", False), ("aws", "x-amz", True), ("aws", "x-aws", False), ("fastly", "fastly", False),
)


def detect_cdn(runs: DataFrame) -> DataFrame:
    """(run_id, cdn_seen) by parts of the headers' names or values; null where none matches."""
    names = F.lower(F.concat_ws(" ", F.map_keys("headers")))
    text = F.lower(F.concat_ws(" ", F.map_keys("headers"), F.map_values("headers")))
    out = F.lit(None).cast("string")
    for name, part, only_names in reversed(CDN):
        out = F.when((names if only_names else text).contains(part), F.lit(name)).otherwise(out)
    return runs.filter("headers is not null").select("run_id", out.alias("cdn_seen"))


def https_seen(runs: DataFrame) -> DataFrame:
    """(run_id, https): the address or any hop is https."""
    return runs.select("run_id", (F.lower("url").startswith("https://") | F.exists(F.coalesce("redirect_chain", F.array().cast("array<string>")), lambda x: F.lower(x).startswith("https://"))).alias("https"))
