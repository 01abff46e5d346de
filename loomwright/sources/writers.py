"""Sinks: crawl logs, runs by host and time, CSV with quoting, and the compact graph of one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def crawl_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def run_folder(df: DataFrame, root: str, mode: str = "append") -> None:
    """Partitioned by host and run_ts; rows of a hot host are spread over files."""
    df.write.mode(mode).option("maxRecordsPerFile", 1_000_000).partitionBy("host", "run_ts").parquet(root)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def key_value(df: DataFrame) -> DataFrame:
    """(key, value) of each column of each row, as text."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in df.columns)
    return df.select(F.expr(f"stack({len(df.columns)}, {pairs}) as (key, value)"))


def envelope(df: DataFrame, section: str, request: dict[str, str]) -> DataFrame:
    """One JSON text for each row: {"request": ..., section: row}."""
    req = F.create_map(*(F.lit(x) for kv in request.items() for x in kv))
    return df.select(F.to_json(F.struct(req.alias("request"), F.struct(*df.columns).alias(section))).alias("value"))


def compact_edges(edges: DataFrame) -> DataFrame:
    """(src_id, dst_id, follow) with 64-bit ids, and the dictionary's ids made of the addresses themselves, so no global numbering is needed."""
    return edges.select(F.xxhash64("src").alias("src_id"), F.xxhash64("dst").alias("dst_id"), "follow")


def reports(df: DataFrame, root: str) -> None:
    """Merged reports as JSON lines by host and time; each row needs host and run_ts."""
    df.write.mode("append").partitionBy("host", "run_ts").json(root)


def jsonld_files(items: DataFrame, root: str, id_col: str) -> None:
    """Each page's JSON-LD items as texts in a folder of their page."""
    items.select(F.col(id_col).cast("string").alias("page"), F.col("item").alias("value")).write.mode("overwrite").partitionBy("page").text(root)


def link_tree(tree: DataFrame, edges: DataFrame, start: str, most: int = 1000) -> str:
    """A crawl tree as indented text, each page under the first page that leads to it; `most` lines, a display's length."""
    rows = tree.orderBy("depth", "url").limit(most).collect()
    depth = {r["url"]: r["depth"] for r in rows}
    few = tree.sparkSession.createDataFrame([(u,) for u in depth], "url string")
    pairs = edges.join(F.broadcast(few.withColumnRenamed("url", "src")), "src", "left_semi").join(F.broadcast(few.withColumnRenamed("url", "dst")), "dst", "left_semi").groupBy("dst", "src").agg(F.lit(1)).collect()  # between `most` pages at most
    under: dict[str, str] = {}
    for p in sorted((p["dst"], p["src"]) for p in pairs):
        if depth[p[1]] == depth[p[0]] - 1:
            under.setdefault(p[0], p[1])
    kids: dict[str, list[str]] = {}
    for u in sorted(under, reverse=True):
        kids.setdefault(under[u], []).append(u)
    out, todo = [], [start] if start in depth else []
    while todo:
        u = todo.pop()
        out.append("  " * depth[u] + u)
        todo.extend(kids.get(u, []))
    return "\n".join(out)
