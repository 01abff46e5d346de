"""Field and lab figures of a page from the JSON answers of a page-speed service, one answer in each row.

JVM expressions over the answer's text. Defined results: an answer that is null or no JSON gives nulls, or no rows where the
result has one row for each metric; a lab figure that is absent is 0; ties are kept in the order of the fixed lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# (metric, name in the answer, good up to, fair up to, divisor of the percentile). Fixed values.
FIELD = (
    ("lcp", "LARGEST_CONTENTFUL_PAINT_MS", 2500, 4000, 1), ("cls", "CUMULATIVE_LAYOUT_SHIFT_SCORE", 0.1, 0.25, 100), ("inp", "INTERACTION_TO_NEXT_PAINT", 200, 500, 1),
    ("fcp", "FIRST_CONTENTFUL_PAINT_MS", 1800, None, 1), ("fid", "FIRST_INPUT_DELAY_MS", 100, 300, 1),
)
# Audits that name something to save. Fixed values.
OPPORTUNITIES = (
    "render-blocking-resources", "unminified-javascript", "unminified-css", "unused-javascript", "unused-css", "modern-image-formats", "offscreen-images",
    "uses-webp-images", "uses-optimized-images", "legacy-javascript", "efficient-animated-gifs",
)
CATEGORIES = ("performance", "accessibility", "best-practices", "seo")
OTHER = ("other", "document", "media")


def at(answer: Column, *steps: str) -> Column:
    return F.get_json_object(answer, "$" + "".join(f"['{s}']" for s in steps))


def number(answer: Column, *steps: str) -> Column:
    return at(answer, *steps).try_cast("double")


def field_metrics(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, metric, value, status, n_buckets) of the field data; none where LCP, CLS and INP are all absent.

    The service gives CLS a hundredfold; an absent metric counts as 0 with the status of a bad one (CLS: good).
    """
    a = F.col(col)
    p = lambda k: number(a, "loadingExperience", "metrics", k, "percentile")
    rows = []
    for metric, key, good, fair, by in FIELD:
        v = p(key) / by
        seen = F.coalesce(v, F.lit(0.0 if metric == "cls" else 9999.0))
        status = F.when(seen <= good, "good").otherwise(F.when(seen <= fair, "warn").otherwise("fail") if fair else F.lit("warn"))
        buckets = F.json_array_length(at(a, "loadingExperience", "metrics", key, "distributions"))
        rows.append(F.struct(F.lit(metric).alias("metric"), F.coalesce(v, F.lit(0.0)).alias("value"), status.alias("status"), buckets.alias("n_buckets")))
    any_ = F.coalesce(*(p(k) for m, k, *_ in FIELD if m in ("lcp", "cls", "inp"))).isNotNull()
    return df.filter(any_).select(id_col, F.explode(F.array(*rows)).alias("x")).select(id_col, "x.*")


def field_buckets(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, metric, min, max, proportion) of the distributions; an open bucket ends at infinity."""
    one = "array<struct<min:double,max:double,proportion:double>>"
    parts = [F.transform(F.from_json(at(F.col(col), "loadingExperience", "metrics", key, "distributions"), one), _bucket(m)) for m, key, *_ in FIELD]
    some = F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))
    return df.select(id_col, F.explode(some).alias("x")).select(id_col, "x.*")


def _bucket(metric: str):
    zero, end = F.lit(0.0), F.lit(float("inf"))
    return lambda b: F.struct(F.lit(metric).alias("metric"), F.coalesce(b["min"], zero).alias("min"), F.coalesce(b["max"], end).alias("max"), F.coalesce(b["proportion"], zero).alias("proportion"))


def lab_columns(a: Column) -> dict[str, Column]:
    """Lab figures and category scores of an answer; 0 where absent."""
    audit = lambda k: number(a, "lighthouseResult", "audits", k, "numericValue")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    score = lambda k: F.floor(zero(number(a, "lighthouseResult", "categories", k, "score")) * 100 + 0.5).cast("bigint")
    return {
        "performance_score": score("performance"), "speed_index_s": zero(F.round(audit("speed-index") / 1000, 2)), "tti_s": zero(F.round(audit("interactive") / 1000, 2)), "tbt_ms": zero(F.round(audit("total-blocking-time"), 0)),
        "lab_cls": zero(F.round(audit("cumulative-layout-shift"), 3)), **{f"{k.replace('-', '_')}_category": score(k) for k in CATEGORIES[1:]},
    }


def resources(a: Column) -> dict[str, Column]:
    """Bytes and requests by kind of resource; the total weight alone where there is no summary."""
    items = F.from_json(at(a, "lighthouseResult", "audits", "resource-summary", "details", "items"), "array<struct<resourceType:string,transferSize:double,requestCount:bigint>>")
    some = lambda kinds, f: F.aggregate(F.filter(items, lambda x: x["resourceType"].isin(*kinds)), F.lit(0.0), lambda s, x: s + F.coalesce(x[f].cast("double"), F.lit(0.0))).cast("bigint")
    kinds = {"script": ("script",), "stylesheet": ("stylesheet",), "image": ("image",), "font": ("font",), "other": OTHER}
    whole = lambda f: F.aggregate(items, F.lit(0.0), lambda s, x: s + F.coalesce(x[f].cast("double"), F.lit(0.0))).cast("bigint")
    weight = F.round(number(a, "lighthouseResult", "audits", "total-byte-weight", "numericValue"), 0).cast("bigint")
    out = {"total_bytes": F.coalesce(whole("transferSize"), weight), "total_requests": whole("requestCount")}
    for k, v in kinds.items():
        out[f"{k}_bytes"] = F.coalesce(some(v, "transferSize"), F.when(weight.isNotNull(), F.lit(0).cast("bigint")))
        out[f"{k}_requests"] = some(v, "requestCount")
    return out


def opportunities(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, audit, savings_ms, savings_bytes, status) of the audits that name something to save."""
    a = F.col(col)
    rows = []
    for k in OPPORTUNITIES:
        ms = F.coalesce(number(a, "lighthouseResult", "audits", k, "numericValue"), F.lit(0.0))
        row = F.struct(F.lit(k).alias("audit"), F.round(ms, 0).cast("bigint").alias("savings_ms"), F.round(number(a, "lighthouseResult", "audits", k, "details", "overallSavingsBytes"), 0).cast("bigint").alias("savings_bytes"), F.when(ms > 1000, "fail").when(ms > 100, "warn").otherwise("pass").alias("status"))
        rows.append(F.when(at(a, "lighthouseResult", "audits", k, "details", "type") == "opportunity", row))
    return df.select(id_col, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select(id_col, "x.*")


def audit_items(df: DataFrame, id_col: str, col: str, audit: str, most: int = 5) -> DataFrame:
    """(id, pos, item): the first items of one audit's details as JSON; `most` is the length of the list that is shown."""
    items = F.from_json(at(F.col(col), "lighthouseResult", "audits", audit, "details", "items"), "array<string>")
    return df.select(id_col, F.posexplode(F.slice(items, 1, most)).alias("pos", "item"))


def preferred(df: DataFrame, id_col: str, strategy_col: str, order_col: str) -> DataFrame:
    """One answer for each page: the first of the mobile ones, else the first."""
    cols = [c for c in df.columns if c != id_col]
    return df.groupBy(id_col).agg(F.min_by(F.struct(*cols), F.struct((F.col(strategy_col) != "mobile").alias("m"), F.col(order_col).alias("o"))).alias("_r")).select(id_col, "_r.*")


def by_priority(crux: Column, field: Column, lab: Column) -> tuple[Column, Column]:
    """(value, source) of a metric: the field record's, else the answer's field data, else the lab's."""
    return F.coalesce(crux, field, lab), F.when(crux.isNotNull(), "crux").when(field.isNotNull(), "field").when(lab.isNotNull(), "lab")
