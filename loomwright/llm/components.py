"""Connected components of a link table, without collecting it.

Alternating large-star and small-star steps (Kiveris et al. 2014): every step is one aggregation and one join on
node ids, the number of steps is logarithmic in practice. Links are cut from their lineage by checkpoint() into the
shared folder after each round, so a lost executor costs no more than a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest id of each linked node's component. Nodes without a link don't occur."""
    edges = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        edges = cut(_small(_large(edges)))
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components didn't settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
