"""Field and lab metrics, and search analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Good and poor limits of each metric. Fixed values.
LIMITS = {"lcp_ms": (2500, 4000), "cls": (0.1, 0.25), "fid_ms": (100, 300), "inp_ms": (200, 500), "fcp_ms": (1800, 3000), "ttfb_ms": (800, 1800)}


def rating(metric: Column, value: Column) -> Column:
    """good, needs improvement or poor; null for an unknown metric or a null value."""
    out = F.lit(None).cast("string")
    for m, (a, b) in LIMITS.items():
        out = F.when(metric == m, F.when(value <= a, "good").when(value <= b, "needs improvement").when(value.isNotNull(), "poor")).otherwise(out)
    return out


def p75(buckets: DataFrame, key: str, low: str, high: str, share: str) -> DataFrame:
    """(key, p75): the middle of the first bucket at which the running share reaches 0.75; an open bucket ends at twice its start.

    A metric has a few buckets, so the running sum is a fold over its own small list.
    """
    g = buckets.filter(F.col(low).isNotNull() & F.col(share).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(low).alias("lo"), F.col(high).alias("hi"), F.col(share).alias("s")))).alias("b"))
    n = F.transform("b", lambda x, i: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), F.aggregate(F.slice("b", F.lit(1), i + 1), F.lit(0.0), lambda s, y: s + y["s"]).alias("run")))
    hit = F.get(F.filter(n, lambda x: x["run"] >= 0.75 - 1e-9), F.lit(0))
    return g.withColumn("_h", hit).select(key, F.when(F.col("_h").isNotNull(), F.when(F.col("_h.hi").isNull() | (F.col("_h.hi") == float("inf")), F.col("_h.lo") * 1.5).otherwise((F.col("_h.lo") + F.col("_h.hi")) / 2)).alias("p75"))


def core_verdict(lcp: Column, cls: Column, inp: Column) -> Column:
    """Whether all three are good; null where LCP or INP is missing."""
    return F.when(lcp.isNull() | inp.isNull() | (lcp <= 0) | (inp <= 0), F.lit(None).cast("boolean")).otherwise((lcp <= 2500) & (F.coalesce(cls, F.lit(0.0)) <= 0.1) & (inp <= 200))


def ranked(search: DataFrame, dimension: str, limit: int = 50) -> DataFrame:
    """Rows of a dimension by clicks: clicks, impressions, ctr, position weighted by impressions."""
    return totals(search, [dimension]).orderBy(F.desc("clicks"), dimension).limit(limit)


def totals(search: DataFrame, dims: list[str]) -> DataFrame:
    c, i = F.sum("clicks"), F.sum("impressions")
    return search.groupBy(*dims).agg(c.alias("clicks"), i.alias("impressions"), F.round(F.try_divide(c, i), 4).alias("ctr"), F.round(F.try_divide(F.sum(F.col("position") * F.col("impressions")), i), 4).alias("position"))


def compare_periods(search: DataFrame, dims: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Totals of two periods and their differences in one pass."""
    inside = lambda p: F.col("date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))
    s = search.filter(inside(a) | inside(b)).groupBy(*dims).agg(*(F.sum(F.when(inside(p), F.col(m)).otherwise(0)).alias(f"{m}_{n}") for n, p in (("now", a), ("before", b)) for m in ("clicks", "impressions")))
    return s.withColumns({f"{m}_change": F.col(f"{m}_now") - F.col(f"{m}_before") for m in ("clicks", "impressions")})


def resolve_property(sites: DataFrame, properties: DataFrame) -> DataFrame:
    """(url, property): the property of each address: its domain or a suffix of it first, else the longest address prefix.

    sites: (url); properties: (property), either "domain:<name>" or an address prefix. Both meet by the registered
    part of the host (its last two labels), so this is an equi join with a residual.
    """
    tail = lambda c: F.regexp_extract(F.lower(c), r"([^./:]+\.[^./:]+)(?:[:/]|$)", 1)
    p = properties.select("property", F.when(F.col("property").startswith("domain:"), F.regexp_replace("property", "^domain:", "")).alias("domain"))
    p = p.withColumn("_t", tail(F.coalesce("domain", F.regexp_replace("property", "^https?://", ""))))
    s = sites.select("url", F.regexp_replace(F.lower("url"), "^https?://", "").alias("_u"))
    s = s.withColumn("_h", F.regexp_extract("_u", "^([^/:?#]*)", 1)).withColumn("_t", tail(F.col("_u")))
    suffix = (F.col("_h") == F.col("domain")) | F.col("_h").endswith(F.concat(F.lit("."), F.col("domain")))
    prefix = F.col("_u").startswith(F.regexp_replace(F.lower("property"), "^https?://", ""))
    j = s.join(p, "_t").filter(F.when(F.col("domain").isNotNull(), suffix).otherwise(prefix))
    return j.groupBy("url").agg(F.max_by("property", F.struct(F.col("domain").isNotNull().cast("int"), F.length("property"))).alias("property"))


def date_range(today: str, start: str | None = None, end: str | None = None, days: int | None = None) -> tuple[str, str]:
    """The first and last day asked for: given ones, else so many days (28 by default) before today."""
    import datetime

    if start and end:
        return start, end
    last = datetime.date.fromisoformat(today)
    return (last - datetime.timedelta(days=days if days is not None else 28)).isoformat(), last.isoformat()


def previous_range(start: str, end: str) -> tuple[str, str]:
    """As many days right before."""
    import datetime

    a, b = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end)
    return (a - (b - a) - datetime.timedelta(days=1)).isoformat(), (a - datetime.timedelta(days=1)).isoformat()


def filtered(search: DataFrame, start: str, end: str, country: str | None = None, device: str | None = None, page: str | None = None) -> DataFrame:
    """Rows of a period and, where given, of a country (lower case), a device (upper case) and a page; all are pushed to the scan."""
    d = search.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    for c, v in (("country", country.lower() if country else None), ("device", device.upper() if device else None), ("page", page)):
        d = d.filter(F.col(c) == v) if v else d
    return d


def page_report(search: DataFrame, page_col: str, query_col: str = "query", most: int = 25) -> DataFrame:
    """(page, query, clicks, impressions, ctr, position, rank): each page's totals (query null, rank 0) and its first `most` queries by clicks."""
    from .graph import top_per_group

    whole = totals(search, [page_col]).select(page_col, F.lit(None).cast("string").alias(query_col), "clicks", "impressions", "ctr", "position", F.lit(0).cast("bigint").alias("rank"))
    top = top_per_group(totals(search, [page_col, query_col]), page_col, [F.desc("clicks"), F.col(query_col)], most)
    return whole.unionByName(top.select(page_col, query_col, "clicks", "impressions", "ctr", "position", F.col("rn").cast("bigint").alias("rank")))
