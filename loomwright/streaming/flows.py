"""Streams: window counts with late data, deduplication, two-phase upserts and per-host backpressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def tumbling(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "45 days") -> DataFrame:
    """(start, key, n): works on streams (watermark) and on tables."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sliding(events: DataFrame, ts: str, key: str, width: str = "2 hours", step: str = "1 hour", late: str = "45 days") -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width, step).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "45 days") -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def visited(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key once: bounded by the watermark on a stream."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])


def upsert(reports: DataFrame, key: str, complete: str) -> DataFrame:
    """The complete report of each key, else its partial one."""
    cols = [c for c in reports.columns if c != key]
    return reports.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(complete).cast("int")).alias("_r")).select(key, "_r.*")


def _step(s: Column) -> Column:
    """The delay's factor after one status as a clamped multiple: k, lowest, highest."""
    row = lambda k, lo, hi: F.struct(F.lit(k).alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    return F.when(s == 429, row(1.5, 1.0, 10.0)).when(s < 400, row(0.95, 1.0, 10.0)).otherwise(row(1.0, 1.0, 10.0))


def _after(a: Column, b: Column) -> Column:
    """First a, then b: clamped multiples are closed under composition, so stretches can be folded by themselves."""
    clamp = lambda x: F.least(b["hi"], F.greatest(b["lo"], b["k"] * x))
    return F.struct((a["k"] * b["k"]).alias("k"), clamp(a["lo"]).alias("lo"), clamp(a["hi"]).alias("hi"))


def _fold(xs: Column) -> Column:
    same = F.struct(F.lit(1.0).alias("k"), F.lit(1.0).alias("lo"), F.lit(10.0).alias("hi"))
    return F.aggregate(xs, same, _after)


def backpressure(statuses: Column) -> Column:
    """The delay's factor after an ordered list of statuses: x 1.5 (10 at most) on 429, x 0.95 (1 at least) on success."""
    f = _fold(F.transform(statuses, _step))
    return F.least(f["hi"], F.greatest(f["lo"], f["k"]))


def backpressure_by(df: DataFrame, key: str, order: str, status: str, stretch: int = 4096) -> DataFrame:
    """(key, factor) after all statuses of each key in their order, a whole number.

    The statuses of `stretch` consecutive numbers are folded to one clamped multiple each, and those are folded again, so
    no list holds all statuses of a hot key.
    """
    d = df.filter(F.col(status).isNotNull()).select(key, F.col(order).alias("_o"), F.floor(F.col(order) / stretch).alias("_b"), F.col(status).alias("_s"))
    each = d.groupBy(key, "_b").agg(_fold(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_s"))), lambda x: _step(x["_s"]))).alias("f"))
    for _ in range(2):  # stretches of stretches
        each = each.withColumn("_c", F.floor(F.col("_b") / stretch)).groupBy(key, "_c").agg(_fold(F.transform(F.array_sort(F.collect_list(F.struct("_b", "f"))), lambda x: x["f"])).alias("f")).withColumnRenamed("_c", "_b")
    whole = each.groupBy(key).agg(_fold(F.transform(F.array_sort(F.collect_list(F.struct("_b", "f"))), lambda x: x["f"])).alias("f"))
    return whole.select(key, F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.col("f.k"))).alias("factor"))


def retry_after(value: Column, now: Column) -> Column:
    """Milliseconds to wait by a Retry-After header, seconds or a date, between 0 and 60,000; null where it is neither."""
    seconds = F.when(F.trim(value).rlike(r"^\d{1,9}$"), F.trim(value).try_cast("bigint"))
    date = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3},\s*|\s*(?:GMT|UTC)$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    ms = F.coalesce(seconds * 1000, (F.unix_millis(date) - F.unix_millis(now)))
    return F.when(ms.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(60_000), ms))).cast("bigint")


def backoff(attempt: Column, base: int = 1000, most: int = 60_000) -> Column:
    """Milliseconds before an attempt, doubled each time."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), attempt)).cast("bigint")


def inlink_counts(links: DataFrame, dst: str = "dst") -> DataFrame:
    """(dst, inlinks) so far: the state of a stream of links (in update mode), or of a table."""
    return links.groupBy(dst).agg(F.count("*").alias("inlinks"))


def rolling_latency(df: DataFrame, key: str, order: list[str], value: str, n: int = 20) -> DataFrame:
    """The mean of the last n values of each row's key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("rolling_mean", F.avg(value).over(w))
