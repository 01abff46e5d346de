"""The link graph of a crawl: edges, degrees, ranks, depths, node classes, clusters and queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls as U
from ..session import bucketed, cut

DEAD_END, DEEP, MANY_EXTERNAL, IN_SITEMAP, INDEXABLE = 1, 2, 4, 8, 16


def latest(crawl: DataFrame, url_col: str = "url", order: str = "page_id") -> DataFrame:
    """The last record of each address; one row for each address in the end, by partial aggregation, not by a window."""
    cols = [c for c in crawl.columns if c != url_col]
    return crawl.filter(F.col(url_col).isNotNull()).groupBy(url_col).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(url_col, "_r.*")


def link_edges(crawl: DataFrame) -> DataFrame:
    """(src, dst, follow, internal), multi-edges kept; a null or empty list of links gives none."""
    e = crawl.select(F.col("url").alias("src"), F.explode("links").alias("l")).select("src", F.col("l.target").alias("dst"), F.col("l.follow").alias("follow"))
    return e.filter("dst is not null").withColumn("internal", U.host(F.col("src")) == U.host(F.col("dst")))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair; it is followed if any of its links is."""
    return edges.groupBy("src", "dst").agg(F.max("follow").alias("follow"), F.max("internal").alias("internal"), F.count("*").alias("n_links"))


def degrees(edges: DataFrame) -> DataFrame:
    """(url, outlinks, out_external, external_domains, inlinks)."""
    out = edges.groupBy(F.col("src").alias("url")).agg(
        F.count_if("internal").alias("outlinks"), F.count_if(~F.col("internal")).alias("out_external"), F.count_distinct(F.when(~F.col("internal"), U.host(F.col("dst")))).alias("external_domains")
    )
    into = edges.filter("internal").groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("inlinks"))
    return out.join(into, "url", "full").na.fill(0)


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 50, damping: float = 0.85, cut_every: int = 10) -> DataFrame:
    """(url, page_rank): ranks over internal links after a fixed number of rounds, divided by the largest, 4 decimals.

    The out-degree counts all internal links, those to pages that weren't crawled as well; the rank of pages without
    links isn't handed on. Addresses are replaced by 64-bit hashes before the loop, or, should two of them be equal, by their numbers.
    Edges and nodes are written once, bucketed by source and by node: a round moves the partial sums of the targets and nothing
    else. The lineage is cut by checkpoint().
    """
    ids = bucketed(nodes.select("url").distinct().withColumn("id", F.xxhash64("url")), "rank_nodes", "id")
    n, different = ids.agg(F.count("*"), F.count_distinct("id")).first()
    if n == 0:
        return nodes.select("url", F.lit(None).cast("double").alias("page_rank"))
    e = edges.filter("internal").select("src", "dst")
    if n == different:
        e = e.select(F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d"))
    else:
        ids = bucketed(dictionary(nodes), "rank_nodes", "id")
        e = e.join(ids.select(F.col("url").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("url").alias("dst"), F.col("id").alias("d")), "dst", "left").select("s", "d")
    deg = e.groupBy("s").agg(F.count("*").alias("deg"))
    e = e.join(ids.select(F.col("id").alias("d")), "d", "left_semi").groupBy("s", "d").agg(F.count("*").alias("k"))
    e = bucketed(e.join(deg, "s").select("s", "d", (F.col("k") / F.col("deg")).alias("w")), "rank_edges", "s")
    base = (1 - damping) / n
    rank = ids.select("id", F.lit(1.0 / n).alias("r"))
    for i in range(1, iterations + 1):
        # hashed by bucket, a few numbers a node: neither the edges nor the nodes are sorted again
        got = e.join(rank.hint("shuffle_hash"), e["s"] == rank["id"]).groupBy("d").agg(F.sum(F.col("r") * F.col("w")).alias("g"))
        rank = ids.select("id").join(got.hint("shuffle_hash"), F.col("id") == F.col("d"), "left").select("id", (F.lit(base) + damping * F.coalesce("g", F.lit(0.0))).alias("r"))
        if i % cut_every == 0:
            rank = cut(rank)
    if iterations % cut_every:
        rank = cut(rank)
    top = max(rank.agg(F.max("r")).first()[0], 1e-9)  # one number
    return ids.join(rank, "id").select("url", F.round(F.col("r") / F.lit(top), 4).alias("page_rank"))


def link_depth(nodes: DataFrame, edges: DataFrame, starts: DataFrame, most: int | None = None, merge_every: int = 10) -> DataFrame:
    """(url, link_depth) of the pages reached from the start pages over internal links.

    Runs until the front is empty; each round reaches at least one new page, so it ends on cycles too. Only where `most`
    is given are pages beyond so many rounds left out. A round writes its own front; the fronts so far are put together
    every `merge_every` rounds, so that no page is written anew in each.
    """
    # targets that are no nodes are dropped once, not in each round; bucketed by source, the edges don't move in a round
    e = bucketed(edges.filter("internal and src <> dst").select("src", "dst").distinct().join(nodes.select(F.col("url").alias("dst")), "dst", "left_semi"), "depth_edges", "src")
    front = cut(nodes.join(starts.select("url").distinct(), "url", "left_semi").select("url", F.lit(0).alias("link_depth")).distinct())
    seen, depth = [front], 0
    while most is None or depth < most:
        depth += 1
        step = front.join(e, front["url"] == e["src"]).select(F.col("dst").alias("url")).distinct()
        for x in seen:
            step = step.join(x.select("url"), "url", "left_anti")
        front = cut(step.select("url", F.lit(depth).alias("link_depth")))
        if front.isEmpty():
            break
        seen.append(front)
        if len(seen) > merge_every:
            seen = [cut(_all(seen))]
    return _all(seen)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def depths(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(url, link_depth, reached) of all pages; of those that no start page reaches, the crawl depth, which may be null."""
    d = link_depth(nodes, edges, starts)
    return nodes.select("url", "crawl_depth").join(d, "url", "left").select("url", F.coalesce("link_depth", "crawl_depth").cast("int").alias("link_depth"), F.col("link_depth").isNotNull().alias("reached"))


def node_type(status: Column, url: Column, inlinks: Column) -> Column:
    """home, then 5xx, 4xx, orphan, normal."""
    home = F.regexp_replace(U.path(url), "/+$", "") == ""
    return F.when(home, "home").when(status >= 500, "error_5xx").when(status >= 400, "error_4xx").when(F.coalesce(inlinks, F.lit(0)) == 0, "orphan").otherwise("normal")


def nodes(crawl: DataFrame, edges: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """Nodes with label, type, degrees, flags and cluster; with an empty sitemap every page counts as in it."""
    n = latest(crawl).join(degrees(edges), "url", "left").na.fill(0, ["inlinks", "outlinks", "out_external", "external_domains"])
    flags = (
        F.when((F.col("status") < 400) & (F.col("outlinks") == 0), DEAD_END).otherwise(0)
        + F.when(F.col("crawl_depth") > 3, DEEP).otherwise(0)
        + F.when(F.col("out_external") > 5, MANY_EXTERNAL).otherwise(0)
        + F.when(F.col("is_indexable"), INDEXABLE).otherwise(0)
    )
    if sitemap is None:
        flags = flags + IN_SITEMAP
    else:
        n = n.join(sitemap.select("url").distinct().withColumn("_s", F.lit(IN_SITEMAP)), "url", "left")
        flags = flags + F.coalesce("_s", F.lit(0))
    label = F.substring(F.coalesce(F.nullif(F.trim("title"), F.lit("")), U.path(F.col("url"))), 1, 80)
    return n.select("url", "status", label.alias("label"), node_type(F.col("status"), F.col("url"), F.col("inlinks")).alias("type"), "inlinks", "outlinks", "out_external", "crawl_depth", flags.cast("int").alias("flags"), U.first_segment(F.col("url")).alias("cluster"), "canonical", "h1", "meta_robots", "is_indexable")


def clusters(node_df: DataFrame, least: int = 2) -> DataFrame:
    return node_df.groupBy("cluster").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= least)


def issues(node_df: DataFrame, kind: str | None = None) -> DataFrame:
    """(section, url): orphans, dead ends, deep pages, too many external links, not in the sitemap, 4xx, 5xx."""
    sections = {
        "orphans": F.col("type") == "orphan", "dead_ends": F.col("flags").bitwiseAND(DEAD_END) != 0, "deep": F.col("flags").bitwiseAND(DEEP) != 0,
        "external_heavy": F.col("flags").bitwiseAND(MANY_EXTERNAL) != 0, "not_in_sitemap": F.col("flags").bitwiseAND(IN_SITEMAP) == 0,
        "errors_4xx": F.col("status").between(400, 499), "errors_5xx": F.col("status").between(500, 599),
    }
    marks = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in sections.items() if kind in (None, k))), lambda x: x.isNotNull())
    return node_df.select(F.explode(marks).alias("section"), "url")


def inspect(node_df: DataFrame, url: str, suggestions: int = 5) -> DataFrame:
    """The node of an address, exactly, with or without a slash at its end, else addresses that contain it."""
    forms = [url, url.rstrip("/"), url.rstrip("/") + "/"]
    rank = F.when(F.col("url") == forms[0], 0).when(F.col("url").isin(forms[1:]), 1).when(F.col("url").contains(url), 2)
    hit = node_df.withColumn("match", rank).filter("match is not null")
    best = hit.agg(F.min("match").alias("m"))
    return hit.join(F.broadcast(best), F.col("match") == F.col("m")).drop("m").orderBy("url").limit(suggestions)


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(url, change): pages that are new, lost, or whose status or depth changed between two runs."""
    j = a.select("url", F.col("status").alias("s0"), F.col("crawl_depth").alias("d0"), F.lit(1).alias("i0")).join(b.select("url", F.col("status").alias("s1"), F.col("crawl_depth").alias("d1"), F.lit(1).alias("i1")), "url", "full")
    change = F.filter(F.array(F.when(F.col("i0").isNull(), F.lit("new")), F.when(F.col("i1").isNull(), F.lit("lost")), F.when(F.col("i0").isNotNull() & F.col("i1").isNotNull() & ~F.col("s0").eqNullSafe(F.col("s1")), F.lit("status")), F.when(F.col("i0").isNotNull() & F.col("i1").isNotNull() & ~F.col("d0").eqNullSafe(F.col("d1")), F.lit("depth"))), lambda x: x.isNotNull())
    return j.select("url", F.explode(change).alias("change"))


def priority(depth: Column, inlinks: Column, fresh: Column) -> Column:
    """0.4 by depth, 0.3 by in-links, 0.3 by freshness (0.15 where unknown)."""
    return F.round(F.coalesce(0.4 / (1 + depth), F.lit(0.0)) + 0.3 * F.least(F.lit(1.0), inlinks / 10) + F.coalesce(0.3 * fresh, F.lit(0.15)), 4)


def top_external(edges: DataFrame, limit: int = 10) -> DataFrame:
    return edges.filter(~F.col("internal")).groupBy(U.host(F.col("dst")).alias("domain")).agg(F.count_distinct("src").alias("n_pages")).orderBy(F.desc("n_pages"), "domain").limit(limit)


def redirect_hops(runs: DataFrame) -> DataFrame:
    """(run_id, hop, src, dst, labels) of each redirect: HTTPS, www and slash changes."""
    h = runs.select("run_id", F.posexplode("redirect_chain").alias("hop", "src"), F.col("redirect_chain").alias("c"))
    h = h.withColumn("dst", F.expr("get(c, hop + 1)")).filter("dst is not null")
    w = lambda c: F.regexp_replace(U.host(F.col(c)), "^www\\.", "")
    labels = F.array_join(
        F.filter(
            F.array(
                F.when(F.lower("src").startswith("http:") & F.lower("dst").startswith("https:"), F.lit("https")),
                F.when((U.host(F.col("src")) != U.host(F.col("dst"))) & (w("src") == w("dst")), F.lit("www")),
                F.when((F.regexp_replace("src", "/+$", "") == F.regexp_replace("dst", "/+$", "")) & (F.col("src") != F.col("dst")), F.lit("slash")),
            ),
            lambda x: x.isNotNull(),
        ),
        ",",
    )
    return h.select("run_id", F.col("hop").cast("int"), "src", "dst", labels.alias("labels"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rn") <= k)


def external_nodes(edges: DataFrame) -> DataFrame:
    """(url, type, inlinks) of one node ext:<host> for each host outside that is linked."""
    return edges.filter(~F.col("internal")).groupBy(F.concat(F.lit("ext:"), U.host(F.col("dst"))).alias("url")).agg(F.count("*").alias("inlinks")).select("url", F.lit("external").alias("type"), "inlinks")


def not_crawled(sitemap: DataFrame, crawl: DataFrame) -> DataFrame:
    """(url) of the sitemap that wasn't crawled."""
    return sitemap.select("url").filter("url is not null").distinct().join(crawl.select("url"), "url", "left_anti")


def dictionary(urls: DataFrame) -> DataFrame:
    """(url, id): the different addresses numbered from 0 in their order, without sorting all of them in one task.

    The addresses are written sorted by range; the driver gets one count for each partition, and an id is a partition's
    offset and the row's number in it.
    """
    d = urls.select("url").filter("url is not null").distinct().repartitionByRange("url").select("url", F.spark_partition_id().alias("_p"))
    d = cut(d)
    sizes = {r["_p"]: r["n"] for r in d.groupBy("_p").agg(F.count("*").alias("n"), F.min("url").alias("u")).orderBy("u").select("_p", "n").collect()}
    base, first = {}, 0
    for p, n in sizes.items():  # in the order of their addresses
        base[p] = first
        first += n
    if not base:
        return d.select("url", F.lit(0).cast("bigint").alias("id"))
    offset = F.create_map(*(F.lit(x) for p, n in base.items() for x in (p, n)))
    w = Window.partitionBy("_p").orderBy("url")
    return d.select("url", (F.try_element_at(offset, F.col("_p")).cast("bigint") + F.row_number().over(w) - 1).alias("id"))


def compact(nodes_df: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(urls, links): the dictionary of all addresses, and the edges as pairs of its ids with their follow flag."""
    ids = cut(dictionary(nodes_df.select("url").unionByName(edges.select(F.col("src").alias("url"))).unionByName(edges.select(F.col("dst").alias("url")))))
    e = dedupe_edges(edges).join(ids.select(F.col("url").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("url").alias("dst"), F.col("id").alias("d")), "dst")
    return ids, e.select(F.col("s").alias("src_id"), F.col("d").alias("dst_id"), "follow")


def expand(urls: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, follow) of a compact graph."""
    a, b = urls.select(F.col("id").alias("src_id"), F.col("url").alias("src")), urls.select(F.col("id").alias("dst_id"), F.col("url").alias("dst"))
    return links.join(a, "src_id").join(b, "dst_id").select("src", "dst", "follow")


def links_of(edges: DataFrame, url: str) -> DataFrame:
    """(direction, url, follow) of the links into and out of an address."""
    e = dedupe_edges(edges)
    return e.filter(F.col("src") == url).select(F.lit("out").alias("direction"), F.col("dst").alias("url"), "follow").unionByName(e.filter(F.col("dst") == url).select(F.lit("in").alias("direction"), F.col("src").alias("url"), "follow"))


def overlay(node_df: DataFrame, search: DataFrame) -> DataFrame:
    """The nodes with clicks, impressions and mean position of their address, null where it has none."""
    s = search.groupBy("url").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.round(F.try_divide(F.sum(F.col("position") * F.col("impressions")), F.sum("impressions")), 4).alias("search_position"))
    return node_df.join(s, "url", "left")


def unranked(overlaid: DataFrame, most: int = 20) -> DataFrame:
    """(section, url, rank): pages without a search position by in-links, ranked pages without in-links, ranked pages deeper than three; `most` of each."""
    ranked = F.col("search_position").isNotNull()
    parts = {"unranked": (~ranked, [F.desc("inlinks"), F.col("url")]), "ranked_orphans": (ranked & (F.col("inlinks") == 0), [F.col("search_position"), F.col("url")]), "ranked_deep": (ranked & (F.col("crawl_depth") > 3), [F.col("search_position"), F.col("url")])}
    out = None
    for name, (where, order) in parts.items():
        d = overlaid.filter(where).orderBy(*order).limit(most)
        d = d.select(F.lit(name).alias("section"), "url", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"))  # over `most` rows
        out = d if out is None else out.unionByName(d)
    return out


def frontier(candidates: DataFrame, visited: DataFrame, batch: int) -> DataFrame:
    """The next `batch` addresses to fetch: not visited, by priority, then address."""
    return candidates.select("url", "priority").join(visited.select("url"), "url", "left_anti").orderBy(F.desc("priority"), "url").limit(batch)


def crawl_tree(edges: DataFrame, start: str, max_depth: int = 3, max_pages: int = 100, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(url, depth) of a crawl over a table of links, breadth first: `max_depth` rounds and `max_pages` pages are its limits.

    include and exclude are path globs. Within a round addresses are taken in their order; each round is one join, and what is
    carried is no more than max_pages rows.
    """
    e = edges.filter("internal and src <> dst").select("src", "dst").distinct()
    ok = F.lit(True)
    for glob, keep in ((include, True), (exclude, False)):
        if glob:
            hit = U.path(F.col("dst")).rlike(U.glob_pattern(glob))
            ok = ok & (hit if keep else ~hit)
    e = cut(e.filter(ok))
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "url string, depth int")
    for depth in range(1, max_depth + 1):
        left = max_pages - seen.count()
        if left <= 0:
            break
        step = e.join(F.broadcast(seen.filter(F.col("depth") == depth - 1)), e["src"] == seen["url"], "left_semi").select(F.col("dst").alias("url")).distinct()  # at most max_pages rows
        new = cut(step.join(F.broadcast(seen), "url", "left_anti").orderBy("url").limit(left).withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
    return seen
