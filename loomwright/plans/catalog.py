"""Registered queries of the core: one entry for each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import texts as X, urls as U
from ..operators import content as C, dom as D, graph as G, jsonld as J, lab as L, markdown as K, metrics as M, nested, pagetext as T, report as R, robots as B
from ..sources import landing as A
from ..streaming import flows as S
from ..session import Query, table, written

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


REPORT_ROOTS = ("scores.performance.cwv", "scores.seo.technical")


def _report_triples(spark: SparkSession, d: str) -> DataFrame:
    return nested.record_triples(table(spark, d, "report_records"), "report_id", "body", REPORT_ROOTS)


@_query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(_report_triples(spark, d), "report_id")


@_query
def p1_cwv_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the metrics, keyed by report and row."""
    return nested.pivot_group(_report_triples(spark, d), "report_id", "scores.performance.cwv", ["metric", "value", "strategy", "note"])


@_query
def p1_cwv_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The buckets' table with typed columns; parent_path is the metric's row_path."""
    t = nested.pivot_group(_report_triples(spark, d), "report_id", "scores.performance.cwv.buckets", ["min", "max", "proportion"])
    num = lambda c: F.expr(f"try_cast(f_{c} AS double)").alias(c)
    return t.select("report_id", "row_path", "parent_path", "ordinal", num("min"), num("max"), num("proportion"))


@_query
def p1_technical_checks(spark: SparkSession, d: str) -> DataFrame:
    return nested.pivot_group(_report_triples(spark, d), "report_id", "scores.seo.technical.checks", ["check", "status"])


# the other groups' tables: query -> (group, fields); parent_path is the row_path of the parent group's table
REPORT_GROUPS = {
    "p1_cwv_by_country": ("scores.performance.cwv.by_country", ["country", "value"]),
    "p1_cwv_by_country_buckets": ("scores.performance.cwv.by_country.buckets", ["min", "max", "proportion"]),
    "p1_technical": ("scores.seo.technical", ["group", "check", "status"]),
    "p1_technical_evidence": ("scores.seo.technical.evidence", ["selector", "found"]),
    "p1_technical_evidence_hints": ("scores.seo.technical.evidence.hints", ["text", "weight"]),
    "p1_technical_checks_evidence": ("scores.seo.technical.checks.evidence", ["selector", "found"]),
    "p1_technical_checks_evidence_hints": ("scores.seo.technical.checks.evidence.hints", ["text", "weight"]),
}


def _report_group(group: str, fields: list[str]) -> Query:
    return lambda spark, d: nested.pivot_group(_report_triples(spark, d), "report_id", group, fields)


QUERIES |= {name: _report_group(*x) for name, x in REPORT_GROUPS.items()}


# ------------------------------------------------------------------------------------------- shared SQL

_RE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '{U.EDGES}', '', 'g')"


def _part(url: str, n: int) -> str:
    return f"regexp_extract({_trim(url)}, '{_RE}', {n})"


def _host(url: str) -> str:
    return f"lower(regexp_replace(regexp_replace({_part(url, 2)}, '^.*@', ''), ':\\d+$', ''))"


def _path(url: str) -> str:
    return f"CASE WHEN {_part(url, 3)} = '' THEN '/' ELSE {_part(url, 3)} END"


def _segment(url: str) -> str:
    s = f"regexp_extract({_path(url)}, '^/+([^/]+)', 1)"
    return f"CASE WHEN {s} = '' THEN 'root' ELSE lower({s}) END"


def _sql(**texts: str) -> None:
    SQL.update(texts)


# ------------------------------------------------------------------------------------------- addresses and pages


def _crawl(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_pages")


@_query
def site_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the crawl: pages, titles and hosts of each first path segment."""
    c = _crawl(spark, d).select(U.first_segment(F.col("url")).alias("cluster"), "host", F.length("title").alias("n"))
    g = c.groupBy("cluster").agg(F.count("*").alias("n_pages"), F.count_distinct("host").alias("n_hosts"), F.round(F.avg("n"), 4).alias("mean_title"))
    return g.filter("n_pages >= 2")


@_query
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d).select("page_id", U.normalize(F.col("url")).alias("url_norm"), U.strip_tracking(F.col("url")).alias("url_clean"))


@_query
def url_structure(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d).select("page_id", *(c.alias(k) for k, c in U.structure(F.col("url")).items()))


@_query
def url_compare_canonical(spark: SparkSession, d: str) -> DataFrame:
    c = _crawl(spark, d)
    j = U.comparable(U.join(F.col("url"), F.col("canonical")))
    return c.select("page_id", (U.comparable(F.col("url")) == j).alias("self_referencing"), F.when(F.col("canonical").isNull(), "missing").when(U.comparable(F.col("url")) == j, "match").otherwise("mismatch").alias("canonical_status"))


@_query
def host_inventory(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d).groupBy(U.host(F.col("url")).alias("url_host")).agg(F.count("*").alias("n_pages"), F.count_if(F.col("status") >= 400).alias("n_errors"), F.max("crawl_depth").alias("max_depth"))


@_query
def title_status(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.length("title"), F.lit(0))
    return _crawl(spark, d).groupBy(F.when(n == 0, "fail").when(n.between(30, 60), "pass").otherwise("warn").alias("title_status")).agg(F.count("*").alias("n_pages"))


@_query
def duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d).filter("title is not null").groupBy("host", "title").agg(F.count("*").alias("n_pages")).filter("n_pages > 1")


@_query
def raw_word_count(spark: SparkSession, d: str) -> DataFrame:
    """Words of the raw html without scripts, styles, tags and entities."""
    t = F.regexp_replace("raw_html", r"(?s)<script.*?</script>|<style.*?</style>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")
    return _crawl(spark, d).filter("raw_html is not null").select("page_id", F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).cast("bigint").alias("n_words"))


@_query
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of links in the raw html, read against the page, each once."""
    c = _crawl(spark, d).select("page_id", "url", F.explode(F.regexp_extract_all("raw_html", F.lit(r'<a\s[^>]*href="([^"#]+)"'), F.lit(1))).alias("href"))
    return c.select("page_id", "href").distinct()


@_query
def tag_frequency(spark: SparkSession, d: str) -> DataFrame:
    c = _crawl(spark, d).select(F.explode(F.regexp_extract_all("raw_html", F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return c.groupBy("tag").agg(F.count("*").alias("n"))


@_query
def html_size_ratio(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace("html", r"<[^>]*>", "")
    return table(spark, d, "page_runs").filter("html is not null").select("run_id", F.octet_length("html").cast("bigint").alias("n_bytes"), F.length("html").cast("bigint").alias("n_chars"), F.length(t).cast("bigint").alias("n_text"))


@_query
def asset_inventory(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return table(spark, d, "page_runs").filter("html is not null").select("run_id", n(r"<img\b").alias("images"), n(r"<script\b").alias("scripts"), n(r"<link\b").alias("link_tags"), n(r'<img\b[^>]*alt=""').alias("empty_alt"), n(r"<a\b").alias("links"))


_sql(
    site_clusters=f"SELECT {_segment('url')} AS cluster, count(*)::BIGINT AS n_pages, count(DISTINCT host)::BIGINT AS n_hosts, round(avg(length(title)), 4) AS mean_title FROM crawl_pages GROUP BY 1 HAVING count(*) >= 2",
    url_structure=f"""SELECT page_id, length(url)::BIGINT AS url_length, len(seg)::BIGINT AS n_segments, length(p) > 1 AND p LIKE '%/' AS trailing_slash, regexp_matches(p, '[A-Z]') AS has_uppercase,
        regexp_matches(p, '[^a-zA-Z0-9/_.-]') AS has_special, contains(p, '//') AS double_slash, len(list_filter(seg, lambda x: regexp_matches(x, '^[a-z][a-z-]{{2,}}$')))::BIGINT AS keyword_segments,
        (length(url) > 75)::BIGINT + regexp_matches(p, '[A-Z]')::BIGINT + regexp_matches(p, '[^a-zA-Z0-9/_.-]')::BIGINT + contains(p, '//')::BIGINT AS n_issues
        FROM (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS seg FROM (SELECT page_id, url, {_path('url')} AS p FROM crawl_pages))""",
    host_inventory=f"SELECT {_host('url')} AS url_host, count(*)::BIGINT AS n_pages, count(*) FILTER (status >= 400)::BIGINT AS n_errors, max(crawl_depth) AS max_depth FROM crawl_pages GROUP BY 1",
    title_status="SELECT CASE WHEN coalesce(length(title), 0) = 0 THEN 'fail' WHEN length(title) BETWEEN 30 AND 60 THEN 'pass' ELSE 'warn' END AS title_status, count(*)::BIGINT AS n_pages FROM crawl_pages GROUP BY 1",
    duplicate_titles="SELECT host, title, count(*)::BIGINT AS n_pages FROM crawl_pages WHERE title IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    raw_word_count="""SELECT page_id, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(raw_html, '<script.*?</script>|<style.*?</style>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '\\s+'), lambda w: w <> ''))::BIGINT AS n_words FROM crawl_pages WHERE raw_html IS NOT NULL""",
    link_extract="""SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(raw_html, '<a\\s[^>]*href="([^"#]+)"', 1)) AS href FROM crawl_pages)""",
    tag_frequency="SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(raw_html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM crawl_pages) GROUP BY 1",
    html_size_ratio="SELECT run_id, strlen(html)::BIGINT AS n_bytes, length(html)::BIGINT AS n_chars, length(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS n_text FROM page_runs WHERE html IS NOT NULL",
    asset_inventory="""SELECT run_id, len(regexp_extract_all(html, '<img\\b'))::BIGINT AS images, len(regexp_extract_all(html, '<script\\b'))::BIGINT AS scripts, len(regexp_extract_all(html, '<link\\b'))::BIGINT AS link_tags, len(regexp_extract_all(html, '<img\\b[^>]*alt=""'))::BIGINT AS empty_alt, len(regexp_extract_all(html, '<a\\b'))::BIGINT AS links FROM page_runs WHERE html IS NOT NULL""",
)


def _clean_sql(u: str) -> str:
    names = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'fbclid', 'gclid', 'ref', 'mc_cid', 'mc_eid', '_ga', '_gl'"
    keep = f"list_filter(string_split(substr({_part(u, 4)}, 2), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({names}))"
    q = f"CASE WHEN len({keep}) > 0 THEN '?' || array_to_string({keep}, '&') ELSE '' END"
    return f"(CASE WHEN {_part(u, 1)} = '' THEN '' ELSE {_part(u, 1)} || ':' END || CASE WHEN {_part(u, 2)} = '' THEN '' ELSE '//' || {_part(u, 2)} END || {_part(u, 3)} || {q} || {_part(u, 5)})"


_sql(
    url_normalize=f"""SELECT page_id, CASE WHEN regexp_matches(lower({_part('c', 3)}), '\\.(?:jpe?g|png|gif|webp|svg|ico|pdf|css|m?js|woff2?|ttf|eot|otf|mp[34]|avi|zip|gz|tar|dmg|exe|apk)$') THEN NULL ELSE lower({_part('c', 1)}) || '://' || lower({_part('c', 2)}) || ({_path('c')}) || {_part('c', 4)} END AS url_norm, k AS url_clean
        FROM (SELECT page_id, {_clean_sql(_trim('url'))} AS c, {_clean_sql('url')} AS k FROM crawl_pages)""",
)

# ------------------------------------------------------------------------------------------- link graph


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.link_edges(_crawl(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(_crawl(spark, d), _edges(spark, d))


@_query
def crawl_latest(spark: SparkSession, d: str) -> DataFrame:
    return G.latest(_crawl(spark, d)).select("url", "page_id", "status")


@_query
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.dedupe_edges(_edges(spark, d)).select("src", "dst", "follow", "internal", "n_links")


@_query
def degree_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d))


@_query
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(G.latest(_crawl(spark, d)), _edges(spark, d))


@_query
def pagerank_three_rounds(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(G.latest(_crawl(spark, d)), _edges(spark, d), iterations=3)


@_query
def link_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth of every page from the start pages (crawl depth 0 or 1), until the front is empty; the crawl depth where no link leads from them."""
    n = G.latest(_crawl(spark, d).select("url", "page_id", "crawl_depth"))
    return G.depths(n, _edges(spark, d), n.filter("crawl_depth <= 1"))


@_query
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("url", "type", "inlinks", "outlinks", "out_external", "flags", "cluster")


@_query
def issue_lists(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each section: orphans, dead ends, deep pages, pages with many external links, 4xx, 5xx."""
    return G.issues(_nodes(spark, d))


@_query
def depth_map(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each crawl depth, in order; null depths as a group of their own."""
    w = Window.partitionBy("crawl_depth").orderBy("url")
    return _nodes(spark, d).select("crawl_depth", "url", "type", F.row_number().over(w).cast("bigint").alias("pos"))


@_query
def external_domains(spark: SparkSession, d: str) -> DataFrame:
    return G.top_external(_edges(spark, d), 10)


@_query
def uncrawled_targets(spark: SparkSession, d: str) -> DataFrame:
    """Internal targets that weren't crawled, with their links."""
    e = _edges(spark, d).filter("internal").groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("n_links"))
    return e.join(_crawl(spark, d).select("url"), "url", "left_anti")


@_query
def crawl_priority(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("url", G.priority(F.col("crawl_depth"), F.col("inlinks"), F.lit(None).cast("double")).alias("priority"))


@_query
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each address against the last."""
    c = _crawl(spark, d)
    first = c.filter("url is not null").groupBy("url").agg(F.min_by(F.struct("status", "crawl_depth"), "page_id").alias("_r")).select("url", "_r.*")
    return G.compare_runs(first, G.latest(c)).groupBy("change").agg(F.count("*").alias("n_pages"))


@_query
def redirect_hops(spark: SparkSession, d: str) -> DataFrame:
    return G.redirect_hops(_with_rare(spark, d))


_E = f"(SELECT src, l.target AS dst, l.follow AS follow, {_host('src')} = {_host('l.target')} AS internal FROM (SELECT url AS src, unnest(links) AS l FROM crawl_pages) WHERE l.target IS NOT NULL)"
_L = "(SELECT * FROM crawl_pages WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)"
_DEG = f"""(SELECT coalesce(o.url, i.url) AS url, coalesce(outlinks, 0) AS outlinks, coalesce(out_external, 0) AS out_external, coalesce(external_domains, 0) AS external_domains, coalesce(inlinks, 0) AS inlinks FROM
    (SELECT src AS url, count(*) FILTER (internal)::BIGINT AS outlinks, count(*) FILTER (NOT internal)::BIGINT AS out_external, count(DISTINCT CASE WHEN NOT internal THEN {_host('dst')} END)::BIGINT AS external_domains FROM {_E} GROUP BY 1) o
    FULL JOIN (SELECT dst AS url, count(*)::BIGINT AS inlinks FROM {_E} WHERE internal GROUP BY 1) i ON o.url = i.url)"""
_NODES = f"""(SELECT url, status, crawl_depth, inlinks, outlinks, out_external, CASE WHEN regexp_replace({_path('url')}, '/+$', '') = '' THEN 'home' WHEN status >= 500 THEN 'error_5xx' WHEN status >= 400 THEN 'error_4xx' WHEN inlinks = 0 THEN 'orphan' ELSE 'normal' END AS type,
    (CASE WHEN status < 400 AND outlinks = 0 THEN 1 ELSE 0 END + CASE WHEN crawl_depth > 3 THEN 2 ELSE 0 END + CASE WHEN out_external > 5 THEN 4 ELSE 0 END + CASE WHEN is_indexable THEN 16 ELSE 0 END + 8)::INT AS flags, {_segment('url')} AS cluster
    FROM (SELECT n.url, n.status, n.crawl_depth, n.is_indexable, coalesce(inlinks, 0) AS inlinks, coalesce(outlinks, 0) AS outlinks, coalesce(out_external, 0) AS out_external FROM {_L} n LEFT JOIN {_DEG} g ON n.url = g.url))"""


def _pagerank_sql(rounds: int) -> str:
    n = f"n AS (SELECT url FROM {_L}), e AS (SELECT src, dst FROM {_E} WHERE internal), o AS (SELECT src, count(*) AS deg FROM e GROUP BY 1), c AS (SELECT count(*)::DOUBLE AS k FROM n), r0 AS (SELECT url, 1.0 / k AS r FROM n, c)"
    steps = [
        f"r{i} AS (SELECT n.url, 0.15 / k + 0.85 * coalesce(g, 0) AS r FROM n CROSS JOIN c LEFT JOIN (SELECT e.dst, sum(p.r / o.deg) AS g FROM e JOIN r{i - 1} p ON e.src = p.url JOIN o ON o.src = e.src GROUP BY 1) x ON x.dst = n.url)"
        for i in range(1, rounds + 1)
    ]
    return f"WITH {', '.join([n, *steps])} SELECT url, round(r / (SELECT greatest(max(r), 1e-9) FROM r{rounds}), 4) AS page_rank FROM r{rounds}"


_sql(
    crawl_latest=f"SELECT url, page_id, status FROM {_L}",
    link_edges=f"SELECT src, dst, bool_or(follow) AS follow, bool_or(internal) AS internal, count(*)::BIGINT AS n_links FROM {_E} GROUP BY 1, 2",
    degree_counts=f"SELECT url, outlinks, out_external, external_domains, inlinks FROM {_DEG}",
    pagerank=_pagerank_sql(50),
    pagerank_three_rounds=_pagerank_sql(3),
    link_depth=f"""WITH RECURSIVE n AS (SELECT url, crawl_depth FROM {_L}), e AS (SELECT DISTINCT src, dst FROM {_E} WHERE internal AND src <> dst AND dst IN (SELECT url FROM n)), w(url, k) USING KEY (url) AS
        (SELECT url, 0 FROM n WHERE crawl_depth <= 1 UNION SELECT e.dst, min(w.k) + 1 FROM w JOIN e ON w.url = e.src LEFT JOIN recurring.w AS r ON r.url = e.dst WHERE r.url IS NULL GROUP BY 1)
        SELECT n.url, coalesce(w.k, n.crawl_depth)::INT AS link_depth, w.k IS NOT NULL AS reached FROM n LEFT JOIN w ON n.url = w.url""",
    graph_nodes=f"SELECT url, type, inlinks, outlinks, out_external, flags, cluster FROM {_NODES}",
    issue_lists=f"""SELECT section, url FROM (SELECT url, unnest(list_filter([CASE WHEN type = 'orphan' THEN 'orphans' END, CASE WHEN flags & 1 <> 0 THEN 'dead_ends' END, CASE WHEN flags & 2 <> 0 THEN 'deep' END, CASE WHEN flags & 4 <> 0 THEN 'external_heavy' END,
        CASE WHEN status BETWEEN 400 AND 499 THEN 'errors_4xx' END, CASE WHEN status BETWEEN 500 AND 599 THEN 'errors_5xx' END], lambda x: x IS NOT NULL)) AS section FROM {_NODES})""",
    depth_map=f"SELECT crawl_depth, url, type, row_number() OVER (PARTITION BY crawl_depth ORDER BY url) AS pos FROM {_NODES}",
    external_domains=f"SELECT {_host('dst')} AS domain, count(DISTINCT src)::BIGINT AS n_pages FROM {_E} WHERE NOT internal GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    uncrawled_targets=f"SELECT dst AS url, count(*)::BIGINT AS n_links FROM {_E} WHERE internal AND dst NOT IN (SELECT url FROM crawl_pages WHERE url IS NOT NULL) GROUP BY 1",
    crawl_priority=f"SELECT url, round(coalesce(0.4 / (1 + crawl_depth), 0) + 0.3 * least(1.0, inlinks / 10.0) + 0.15, 4) AS priority FROM {_NODES}",
    compare_runs=f"""SELECT change, count(*)::BIGINT AS n_pages FROM (SELECT unnest(list_filter([CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.crawl_depth IS DISTINCT FROM b.crawl_depth THEN 'depth' END], lambda x: x IS NOT NULL)) AS change
        FROM (SELECT * FROM crawl_pages WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1) a JOIN {_L} b ON a.url = b.url) GROUP BY 1""",
)

# ------------------------------------------------------------------------------------------- texts


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@_query
def doc_volume(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    w = F.size(X.words(t)).cast("bigint")
    return _docs(spark, d).select("doc_id", w.alias("n_words"), F.length(t).cast("bigint").alias("n_chars"), F.size(X.sentences(t)).cast("bigint").alias("n_sentences"), F.size(X.paragraphs(t)).cast("bigint").alias("n_paragraphs"), X.depth_label(w).alias("depth"), F.bround(w / 200.0, 1).alias("reading_minutes"))


@_query
def lexical_diversity(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.diversity(F.coalesce("text", F.lit(""))).alias("diversity"))


@_query
def sentence_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of the sentences' lengths in words."""
    n = F.transform(X.sentences(F.coalesce("text", F.lit(""))), lambda s: F.size(X.words(s)))
    return _docs(spark, d).select("doc_id", n.alias("n")).select("doc_id", X.nearest_rank(F.col("n"), 0.5).alias("p50"), X.nearest_rank(F.col("n"), 0.9).alias("p90"), F.array_max("n").alias("longest"))


@_query
def language_guess(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.guess_language(F.coalesce("text", F.lit(""))).alias("guess"))


def _read(spark: SparkSession, d: str) -> DataFrame:
    return C.prepared(_docs(spark, d), "text", None)


@_query
def passive_voice(spark: SparkSession, d: str) -> DataFrame:
    """Passive forms of each text, its markup taken off."""
    return _read(spark, d).select("doc_id", C.count(F.col("_plain"), C.PASSIVE).alias("n_passive"))


@_query
def readability(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, reading ease by the formula of the text's language, level and fog index."""
    r = C.readability()
    return _read(spark, d).select("doc_id", *(r[k].alias(k) for k in ("sentence_count", "reading_ease", "reading_level", "fog_index", "long_sentences")))


@_query
def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent words of each text that aren't stop words of its language, ties by first occurrence."""
    return C.top_keywords(_docs(spark, d), "doc_id", "text")


@_query
def top_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent pairs of neighbours of each text that occur twice."""
    return C.top_phrases(_docs(spark, d), "doc_id", "text", 2)


@_query
def top_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return C.top_phrases(_docs(spark, d), "doc_id", "text", 3)


@_query
def year_mentions(spark: SparkSession, d: str) -> DataFrame:
    y = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b((?:19|20)\d\d)\b"), F.lit(1))))
    return _docs(spark, d).filter("text is not null").select("doc_id", F.array_join(y, ",").alias("years"), F.regexp_count("text", F.lit(r"\d+(?:\.\d+)? ?%")).cast("bigint").alias("n_percent"))


@_query
def transition_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Transition words of each text's language, their share of all words and its label."""
    r = C.style()
    return _read(spark, d).select("doc_id", *(r[k].alias(k) for k in ("transitions", "transition_ratio", "transition_label")))


@_query
def duplicate_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = F.filter(F.transform(X.sentences(F.coalesce("text", F.lit(""))), lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) >= 15)
    return _docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", (F.size("s") - F.size(F.array_distinct("s"))).cast("bigint").alias("n_duplicates"))


@_query
def keyword_stuffing(spark: SparkSession, d: str) -> DataFrame:
    """The share of the most frequent word that isn't a stop word, and whether it is above 5 %."""
    w = C.without_stops(X.tokens(F.col("_plain")), F.col("_lang"))
    share = F.when(F.size("w") > 0, C.longest_run(F.col("w")) / F.size("w")).otherwise(F.lit(0.0))
    return _read(spark, d).select("doc_id", w.alias("w")).select("doc_id", F.round(share, 6).alias("share"), (share > 0.05).alias("stuffed"))


@_query
def markdown_inventory(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.regexp_count("markdown", F.lit(p)).cast("bigint")
    return table(spark, d, "page_splits").filter("markdown is not null").select("run_id", n(r"(?m)^#{1,6} ").alias("headings"), n(r"!\[[^\]]*\]\(").alias("images"), n(r"\]\(").alias("targets"), n(r"(?m)^ *(?:[-*+]|\d+\.) ").alias("items"), n(r"(?m)^\|").alias("table_lines"), n(r"(?m)^> ").alias("quote_lines"))


_T = "coalesce(text, '')"
_X = "regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+')"
_W = "list_transform(" + _X + ", lambda w: lower(w))"
_WORDS = _W.format(t=_T)
_SENT = f"list_filter(list_transform(regexp_split_to_array({_T}, '[.!?]+'), lambda s: {_trim('s')}), lambda s: s <> '')"
_TOK = "list_transform(list_filter({w}, lambda w: regexp_matches(w, '^[a-zA-Z]{{2,}}$')), lambda w: lower(w))".format(w=_X.format(t="text"))
_RANK = "list_sort(n)[round_even({p} * (len(n) - 1), 0)::INT + 1]"
# the words and phrases again, so that the SQL doesn't depend on the engine's tables. Fixed values.
_STOP = {
    "en": """the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should may might can
        this that these those it its they them their we our you your i my he she his her not no so if about which who what when where how all any both also just
        more than then up out into""",
    "de": """der die das und oder ist sind war waren ein eine einem einer eines den dem des von mit auf in an bei zu als auch noch aber wenn dann nicht sich es sie
        er wir ihr ich du mein meine sein seine unser unsere dieser diese dieses jede jeder alle mehr so wie was wo wann wer""",
    "es": """el la los las un una unos unas y o es son era eran ser estar de en con por para que como pero si no se su sus mi tu yo nosotros ellos ellas este esta
        estos estas al del le les lo también ya cuando donde""",
}
_STOP_LIST = {k: "[" + ", ".join(f"'{x}'" for x in v.split()) + "]" for k, v in _STOP.items()}
_GUESS_OF = lambda t: {k: f"len(list_intersect(list_distinct(list_transform(list_filter({_X.format(t=t)}, lambda w: regexp_matches(w, '^[a-zA-Z]{{2,}}$')), lambda w: lower(w))), {v}))" for k, v in _STOP_LIST.items()}
_GUESS = _GUESS_OF(_T)
_TRANSITION = {
    "en": "however|therefore|furthermore|additionally|moreover|consequently|nevertheless|although|meanwhile|subsequently|accordingly|thus|hence|otherwise|nonetheless",
    "de": "jedoch|daher|außerdem|zusätzlich|darüber hinaus|folglich|dennoch|obwohl|inzwischen|anschließend",
    "es": "sin embargo|por lo tanto|además|asimismo|no obstante|en consecuencia|aunque|mientras tanto|posteriormente",
}
_sql(
    doc_volume=f"""SELECT doc_id, w::BIGINT AS n_words, length({_T})::BIGINT AS n_chars, len({_SENT})::BIGINT AS n_sentences, len(list_filter(regexp_split_to_array({_T}, '\\n{{2,}}'), lambda s: {_trim('s')} <> ''))::BIGINT AS n_paragraphs,
        CASE WHEN w < 100 THEN 'thin' WHEN w < 300 THEN 'short' WHEN w < 800 THEN 'adequate' ELSE 'comprehensive' END AS depth, round_even(w / 200.0, 1) AS reading_minutes FROM (SELECT *, len({_WORDS}) AS w FROM documents)""",
    lexical_diversity=f"SELECT doc_id, CASE WHEN len(w) > 0 THEN round_even(len(list_distinct(w)) / len(w)::DOUBLE, 3) ELSE 0.0 END AS diversity FROM (SELECT doc_id, {_WORDS} AS w FROM documents)",
    sentence_percentiles=f"SELECT doc_id, {_RANK.format(p=0.5)}::INT AS p50, {_RANK.format(p=0.9)}::INT AS p90, list_max(n)::INT AS longest FROM (SELECT doc_id, list_transform({_SENT}, lambda s: len({_W.format(t='s')})) AS n FROM documents)",
    language_guess=f"SELECT doc_id, CASE WHEN en >= de AND en >= es THEN 'en' WHEN de >= es THEN 'de' ELSE 'es' END AS guess FROM (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _GUESS.items())} FROM documents)",
    year_mentions="SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b((?:19|20)\\d\\d)\\b', 1))), ',') AS years, len(regexp_extract_all(text, '\\d+(?:\\.\\d+)? ?%'))::BIGINT AS n_percent FROM documents WHERE text IS NOT NULL",
    duplicate_sentences=f"SELECT doc_id, (len(s) - len(list_distinct(s)))::BIGINT AS n_duplicates FROM (SELECT doc_id, list_filter(list_transform({_SENT}, lambda x: lower(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 15) AS s FROM documents)",
    markdown_inventory="""SELECT run_id, len(regexp_extract_all(markdown, '(?m)^#{1,6} '))::BIGINT AS headings, len(regexp_extract_all(markdown, '!\\[[^\\]]*\\]\\('))::BIGINT AS images, len(regexp_extract_all(markdown, '\\]\\('))::BIGINT AS targets,
        len(regexp_extract_all(markdown, '(?m)^ *(?:[-*+]|\\d+\\.) '))::BIGINT AS items, len(regexp_extract_all(markdown, '(?m)^\\|'))::BIGINT AS table_lines, len(regexp_extract_all(markdown, '(?m)^> '))::BIGINT AS quote_lines FROM page_splits WHERE markdown IS NOT NULL""",
)


def _plain_sql(x: str) -> str:
    """A markdown's text without its markup."""
    for pattern, put in (
        ("(?s)```.*?```", ""), ("`[^`]*`", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}([^*]*)\*{1,3}", r"\1"), ("_{1,3}([^_]*)_{1,3}", r"\1"),
        (r"(?m)^>\s+", ""), (r"(?m)^[-*_]{3,}\s*$", ""), (r"\n{3,}", "\n\n"), (r"[ \t]+", " "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return _trim(x)


def _by_lang(of) -> str:
    return f"CASE lang WHEN 'de' THEN {of('de')} WHEN 'es' THEN {of('es')} ELSE {of('en')} END"


_ASCII = "list_transform(list_filter(regexp_extract_all(plain, '[\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[a-zA-Z]{2,}$')), lambda w: lower(w))"
_READ = f"""(SELECT *, CASE WHEN en >= de AND en >= es THEN 'en' WHEN de >= es THEN 'de' ELSE 'es' END AS lang, {_ASCII} AS tok, regexp_extract_all(plain, '[\\p{{L}}\\p{{N}}_]+') AS words FROM
    (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _GUESS_OF('plain').items())} FROM (SELECT doc_id, text, {_plain_sql("coalesce(text, '')")} AS plain FROM documents)))"""
_KEPT = _by_lang(lambda k: f"list_filter(tok, lambda w: NOT list_contains({_STOP_LIST[k]}, w))")
_WORD = r"(?:^|[^\p{L}\p{N}_])"


def _phrases(n: int) -> str:
    gram = " || ' ' || ".join(f"tok[i + {k}]" if k else "tok[i]" for k in range(n))
    content = _by_lang(lambda k: f"len(list_filter(string_split(g, ' '), lambda w: length(w) >= 3 AND NOT list_contains({_STOP_LIST[k]}, w))) > 0")
    return f"""SELECT doc_id, g AS phrase, n, round(n / greatest(total, 1)::DOUBLE * 100, 2) AS percentage, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM
        (SELECT doc_id, lang, g, total, count(*)::BIGINT AS n, min(pos) AS first FROM (SELECT doc_id, lang, len(tok) - {n - 1} AS total, unnest(gs) AS g, generate_subscripts(gs, 1) AS pos FROM
        (SELECT doc_id, lang, tok, list_transform(range(1, len(tok) - {n - 2}), lambda i: {gram}) AS gs FROM {_READ})) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2) WHERE {content}) WHERE rank <= 10"""


_LONG = r"regexp_extract_all(' ' || replace(plain, ' ', '  ') || ' ', '[^\p{L}\p{N}_]([a-zA-Z]+)[^\p{L}\p{N}_]', 1)"
_sql(
    passive_voice=f"SELECT doc_id, len(regexp_extract_all(plain, '(?i)\\b(?:was|were|is|are|been|being|be)\\s+[\\p{{L}}\\p{{N}}_]+ed\\b'))::BIGINT AS n_passive FROM {_READ}",
    top_keywords=f"""SELECT doc_id, word, n, round(n / total::DOUBLE * 100, 2) AS percentage, rank FROM (SELECT doc_id, word, total, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank FROM
        (SELECT doc_id, len(t) AS total, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {_KEPT} AS t FROM {_READ})) GROUP BY 1, 2, 3) WHERE rank <= 10""",
    top_bigrams=_phrases(2),
    top_trigrams=_phrases(3),
    transition_ratio=f"""SELECT doc_id, n::BIGINT AS transitions, r AS transition_ratio, CASE WHEN r < 0.01 THEN 'low' WHEN r < 0.03 THEN 'moderate' ELSE 'good' END AS transition_label FROM (SELECT *, CASE WHEN len(words) > 0 THEN round_even(n / len(words)::DOUBLE, 4) ELSE 0.0 END AS r FROM
        (SELECT *, {_by_lang(lambda k: ' + '.join(f"len(regexp_extract_all(lower(plain), '{chr(92)}b{x}{chr(92)}b'))" for x in _TRANSITION[k].split('|')))} AS n FROM {_READ}))""",
    keyword_stuffing=f"""SELECT doc_id, round(coalesce(m, 0.0), 6) AS share, coalesce(m, 0.0) > 0.05 AS stuffed FROM (SELECT doc_id FROM documents) a LEFT JOIN (SELECT doc_id, max(n) / sum(n)::DOUBLE AS m FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_KEPT}) AS word FROM {_READ}) GROUP BY 1, 2) GROUP BY 1) b USING (doc_id)""",
)

# ------------------------------------------------------------------------------------------- headers, metrics, search, reports


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_runs")


@_query
def security_headers(spark: SparkSession, d: str) -> DataFrame:
    return R.security_headers(_runs(spark, d))


@_query
def caching_policy(spark: SparkSession, d: str) -> DataFrame:
    return R.caching(_runs(spark, d))


@_query
def cdn_compression(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).groupBy("cdn", "compression").agg(F.count("*").alias("n_runs"), F.round(F.avg("ttfb_ms"), 3).alias("mean_ttfb"))


@_query
def metric_ratings(spark: SparkSession, d: str) -> DataFrame:
    m = p1_cwv_metrics(spark, d).select(F.col("f_metric").alias("metric"), F.expr("try_cast(f_value as double)").alias("value"))
    return m.groupBy("metric", M.rating(F.col("metric"), F.col("value")).alias("rating")).agg(F.count("*").alias("n"))


@_query
def metric_p75(spark: SparkSession, d: str) -> DataFrame:
    """p75 of each metric row from its buckets."""
    b = p1_cwv_buckets(spark, d).withColumn("key", F.concat_ws("|", F.col("report_id").cast("string"), "parent_path"))
    return M.p75(b, "key", "min", "max", "proportion")


def _search(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the search digests: query, clicks, impressions, position, with the day and the source of their document."""
    t = _docs(spark, d).filter("doc_kind = 'search_digest' and text is not null")
    x = t.select("source", F.to_date("captured_at").alias("date"), F.explode(F.split("text", r"\r\n|\n|\r")).alias("x")).select("source", "date", F.split("x", "\t").alias("c")).filter("size(c) = 4 and c[0] <> 'query'")
    n = lambda e, k: F.expr(f"try_cast({e} as {k})")
    return x.select("source", "date", F.col("c")[0].alias("query"), n("c[1]", "bigint").alias("clicks"), n("c[2]", "bigint").alias("impressions"), n("c[3]", "double").alias("position")).filter("impressions is not null")


@_query
def search_top_queries(spark: SparkSession, d: str) -> DataFrame:
    return M.ranked(_search(spark, d), "query", 50)


@_query
def search_by_source(spark: SparkSession, d: str) -> DataFrame:
    return M.totals(_search(spark, d), ["source"])


@_query
def search_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).rollup("source", "date").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))


_S = r"""(SELECT source, date, c[1] AS query, try_cast(c[2] AS BIGINT) AS clicks, try_cast(c[3] AS BIGINT) AS impressions, try_cast(c[4] AS DOUBLE) AS position FROM (SELECT source, date, string_split(x, chr(9)) AS c FROM
    (SELECT source, captured_at::DATE AS date, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS x FROM documents WHERE doc_kind = 'search_digest' AND text IS NOT NULL)) WHERE len(c) = 4 AND c[1] <> 'query' AND try_cast(c[3] AS BIGINT) IS NOT NULL)"""
_TOT = "sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, CASE WHEN sum(impressions) <> 0 THEN round(sum(clicks) / sum(impressions)::DOUBLE, 4) END AS ctr, CASE WHEN sum(impressions) <> 0 THEN round(sum(position * impressions) / sum(impressions)::DOUBLE, 4) END AS position"
_H = "list_transform(map_keys(headers), lambda k: lower(k))"
_SEC = "[" + ", ".join(f"'{x}'" for x in R.SECURITY) + "]"
_sql(
    security_headers=f"SELECT run_id, n::BIGINT AS n_present, CASE WHEN n >= 5 THEN 'good' WHEN n >= 3 THEN 'moderate' ELSE 'poor' END AS grade, array_to_string(list_sort(list_filter({_SEC}, lambda x: NOT list_contains(h, x))), ',') AS missing FROM (SELECT run_id, {_H} AS h, len(list_intersect({_H}, {_SEC})) AS n FROM page_runs WHERE headers IS NOT NULL)",
    caching_policy="SELECT run_id, cc IS NOT NULL AS has_cache_control, try_cast(nullif(regexp_extract(cc, 'max-age=(\\d+)', 1), '') AS BIGINT) AS max_age, coalesce(contains(cc, 'no-store'), false) AS no_store, coalesce(try_cast(nullif(regexp_extract(cc, 'max-age=(\\d+)', 1), '') AS BIGINT) < 300, false) AS short_ttl FROM (SELECT run_id, lower(headers['cache-control']) AS cc FROM page_runs WHERE headers IS NOT NULL)",
    cdn_compression="SELECT cdn, compression, count(*)::BIGINT AS n_runs, round(avg(ttfb_ms), 3) AS mean_ttfb FROM page_runs GROUP BY 1, 2",
    search_top_queries=f"SELECT query, {_TOT} FROM {_S} GROUP BY 1 ORDER BY clicks DESC, query LIMIT 50",
    search_by_source=f"SELECT source, {_TOT} FROM {_S} GROUP BY 1",
    search_rollup=f"SELECT source, date, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions FROM {_S} GROUP BY ROLLUP (source, date)",
)


# ------------------------------------------------------------------------------------------- DOM, JSON-LD, robots


def _dom(spark: SparkSession, d: str) -> DataFrame:
    return D.dom_nodes(_runs(spark, d), "run_id", "html")


@_query
def dom_summary(spark: SparkSession, d: str) -> DataFrame:
    return D.summary(_dom(spark, d), "run_id")


@_query
def dom_metadata(spark: SparkSession, d: str) -> DataFrame:
    return D.metadata(_dom(spark, d), "run_id")


@_query
def dom_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Elements by tag over all pages, from the relational DOM."""
    return D.tag_counts(_dom(spark, d), "run_id").groupBy("tag").agg(F.sum("n").alias("n"))


@_query
def heading_outline(spark: SparkSession, d: str) -> DataFrame:
    """Each heading with its level, text, the level before, whether a level is skipped, and the text of its parent."""
    h = D.headings(_dom(spark, d), "run_id")
    w = Window.partitionBy("run_id").orderBy("node_id")
    h = h.withColumn("pos", F.row_number().over(w).cast("bigint"))
    up = h.select("run_id", F.col("node_id").alias("parent_id"), F.col("pos").alias("parent_pos"))
    return h.join(up, ["run_id", "parent_id"], "left").select("run_id", "pos", "level", "text", "previous_level", "skipped", "parent_pos")


@_query
def region_density(spark: SparkSession, d: str) -> DataFrame:
    return D.region_words(_dom(spark, d), "run_id")


# two pages with markup that the tables lack, beside all of theirs
RARE = (
    """<html><head><script src="https://www.googletagmanager.com/gtm.js"></script><script src="//cdn.jsdelivr.net/x.js"></script><script src="https://static.rare.example/own.js"></script></head><body><main><img src="a.webp" width="4" height="5"><img src="b.png" width="2" height="2"></main>
    <label for="a">A</label><input id="a"><label>B <input></label><input id="c"><input type="hidden"><input type="submit"><iframe src="https://video.example/v"></iframe></body></html>""",
    """<html><body><ul><li><a href="#one">1</a></li><li><a href="#two">2</a></li><li><a href="#three">3</a></li></ul><h2 id="one">One</h2><h2 id="two">Two</h2><h3 id="three">one</h3></body></html>""",
)


def _with_rare(spark: SparkSession, d: str) -> DataFrame:
    chain = ["http://rare.example/a", "https://rare.example/a", "https://www.rare.example/a", "https://www.rare.example/a/"]
    more = spark.createDataFrame([(-1 - i, "https://rare.example/a", h, chain if i == 0 else []) for i, h in enumerate(RARE)], "run_id bigint, url string, html string, redirect_chain array<string>")
    return _runs(spark, d).select("run_id", "url", "html", "redirect_chain").unionByName(more)


def _rare_dom(spark: SparkSession, d: str) -> DataFrame:
    return written(D.dom_nodes(_with_rare(spark, d), "run_id", "html"), "dom")  # read by several branches


@_query
def unlabelled_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs without a label, by page."""
    return D.unlabelled_inputs(_rare_dom(spark, d), "run_id").groupBy("run_id").agg(F.count("*").alias("n"))


@_query
def largest_images(spark: SparkSession, d: str) -> DataFrame:
    return D.largest_image(_rare_dom(spark, d), "run_id")


@_query
def frame_hosts(spark: SparkSession, d: str) -> DataFrame:
    return D.frame_hosts(_rare_dom(spark, d), "run_id")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    # written once: six aggregations read it, and no html is parsed again
    dom = written(_dom(spark, d), "dom")
    runs = _runs(spark, d)
    return R.merged(runs, D.summary(dom, "run_id"), D.metadata(dom, "run_id"), table(spark, d, "content_analysis"), D.in_form_audit(dom, "run_id"), D.third_party(dom, runs, "run_id"))


@_query
def issue_rules(spark: SparkSession, d: str) -> DataFrame:
    """Issues of every run by rule: the merged report, one row for each rule that holds."""
    return R.issues(_merged(spark, d))


@_query
def report_heads(spark: SparkSession, d: str) -> DataFrame:
    """Status, delivery network and issues by severity of every run."""
    page = _merged(spark, d)
    return R.front_matter(R.issues(page), page)


@_query
def jsonld_scores(spark: SparkSession, d: str) -> DataFrame:
    """Validation of the JSON-LD documents."""
    t = _docs(spark, d).filter("doc_kind = 'jsonld' and text is not null").select("doc_id", F.col("text").alias("item"))
    v = J.validate(t, "doc_id", context=False)
    return v.select("doc_id", F.array_join("types", ",").alias("types"), F.array_join("missing_required", ",").alias("missing_required"), F.array_join("missing_recommended", ",").alias("missing_recommended"), F.array_join("format_errors", ",").alias("format_errors"), "score")


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return B.parse(_docs(spark, d).filter("doc_kind = 'robots_txt'"), "doc_id", "text")


@_query
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d)


@_query
def robots_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every path named in a file against all of that file's rules."""
    r = _rules(spark, d).withColumnRenamed("doc_id", "host")
    paths = r.filter("kind in ('allow','disallow') and value <> ''").select("host", F.concat("value", F.lit("page.html")).alias("path"))
    return B.verdicts(paths, r)


# ------------------------------------------------------------------------------------------- events


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@_query
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.tumbling(_events(spark, d), "ts", "event_type")


@_query
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.sliding(_events(spark, d), "ts", "event_type")


@_query
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.sessions(_events(spark, d), "ts", "user_id")


@_query
def rolling_latency(spark: SparkSession, d: str) -> DataFrame:
    return S.rolling_latency(_events(spark, d), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("rolling_mean", 6).alias("rolling_mean"))


@_query
def event_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return _events(spark, d).groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count("*").alias("n"))


@_query
def backpressure(spark: SparkSession, d: str) -> DataFrame:
    """The delay factor of each host after its responses in the order of their delivery."""
    return S.backpressure_by(_crawl(spark, d), "host", "page_id", "status").select("host", F.round("factor", 6).alias("factor"))


@_query
def report_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The latest analysis of each run: complete rows (with a score) before partial ones."""
    a = table(spark, d, "content_analysis").select("run_id", "score", "word_count", F.col("score").isNotNull().alias("complete")).distinct()
    return S.upsert(a, "run_id", "complete").select("run_id", "score", "word_count")


_sql(
    tumbling_counts="SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2",
    sliding_counts="SELECT start, event_type, count(*)::BIGINT AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2",
    session_windows="""SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*)::BIGINT AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events)) GROUP BY user_id, g""",
    rolling_latency="SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM events",
    event_json="SELECT event_type, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k, count(*)::BIGINT AS n FROM events GROUP BY 1",
    report_upsert="SELECT run_id, score, word_count FROM (SELECT DISTINCT run_id, score, word_count FROM content_analysis) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY (score IS NOT NULL) DESC) = 1",
)


# ------------------------------------------------------------------------------------------- markdown, page text, scores


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_splits")


@_query
def markdown_structure(spark: SparkSession, d: str) -> DataFrame:
    return K.structure(_splits(spark, d), "run_id", "markdown")


@_query
def heading_skips(spark: SparkSession, d: str) -> DataFrame:
    return K.heading_skips(_splits(spark, d), "run_id", "markdown")


@_query
def anchor_classes(spark: SparkSession, d: str) -> DataFrame:
    return K.links(_splits(spark, d), "run_id", "markdown", "url").groupBy("run_id", "anchor_class", "internal").agg(F.count("*").alias("n"))


@_query
def link_density(spark: SparkSession, d: str) -> DataFrame:
    """Link targets for 1,000 words of each markdown."""
    n, w = F.regexp_count("markdown", F.lit(r"\]\(")), F.size(X.words(F.col("markdown")))
    return _splits(spark, d).filter("markdown is not null").select("run_id", F.round(n * 1000 / F.greatest(w, F.lit(1)), 3).alias("links_per_1000"))


def _page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each markdown with the title and description of its run's html; one row for each run_id."""
    x = lambda p: F.nullif(U.trim(F.regexp_extract("html", p, 1)), F.lit(""))
    head = _runs(spark, d).groupBy("run_id").agg(F.max("html").alias("html")).select("run_id", x(r"(?i)<title[^>]*>([^<]*)</title>").alias("title"), x(r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)["']""").alias("description"))
    return _splits(spark, d).groupBy("run_id").agg(F.max("url").alias("url"), F.max("markdown").alias("markdown")).join(head, "run_id", "left")


@_query
def content_scores(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis of each page's text: every signal, score, label and issues."""
    return C.analyse(_page_texts(spark, d), "run_id", "markdown", "title", "description", "url", 2026)


@_query
def sentences_alike(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sentences of each markdown that have more than four fifths of their words in common."""
    return C.alike_sentences(_splits(spark, d).groupBy("run_id").agg(F.max("markdown").alias("markdown")), "run_id", "markdown")


@_query
def page_extract(spark: SparkSession, d: str) -> DataFrame:
    """Title, first h1, canonical and robots by pattern from the raw html."""
    x = lambda p: F.nullif(F.trim(F.regexp_extract("raw_html", p, 1)), F.lit(""))
    c = _crawl(spark, d).filter("raw_html is not null")
    return c.select("page_id", x(r"(?is)<title[^>]*>([^<]*)</title>").alias("title_seen"), x(r"(?is)<h1[^>]*>([^<]*)</h1>").alias("h1_seen"), x(r'(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"').alias("canonical_seen"), x(r'(?i)<meta[^>]*name="robots"[^>]*content="([^"]*)"').alias("robots_seen"))


@_query
def indexable(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page may be indexed by its tag and status, against what the crawl says."""
    rule = (F.col("status") > 0) & (F.col("status") < 400) & ~F.coalesce(F.lower("meta_robots").contains("noindex"), F.lit(False))
    return _crawl(spark, d).groupBy("is_indexable", rule.alias("by_rule")).agg(F.count("*").alias("n_pages"))


@_query
def soft_404(spark: SparkSession, d: str) -> DataFrame:
    """Pages of status 200 whose title speaks of an error and whose text is short."""
    t = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>", " "), r"<[^>]*>", " "))
    title = F.lower(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)</title>", 1))
    return _runs(spark, d).filter("status = 200 and html is not null").select("run_id", title.rlike("404|not found|page does not exist").alias("title_hit"), F.length(F.regexp_replace(t, r"\s+", " ")).cast("bigint").alias("n_text")).filter("title_hit and n_text < 1000")


@_query
def score_labels(spark: SparkSession, d: str) -> DataFrame:
    """Scores by label (80, 60, 40)."""
    s = F.col("score")
    a = table(spark, d, "content_analysis").select("run_id", "score").distinct()
    return a.groupBy(C.score_label(s).alias("label")).agg(F.count("*").alias("n_runs"), F.round(F.avg("score"), 4).alias("mean_score"))


@_query
def content_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues named in the analyses, with the runs that have them."""
    return table(spark, d, "content_analysis").select("run_id", F.explode("issues").alias("issue")).distinct().groupBy("issue").agg(F.count("*").alias("n_runs"))


@_query
def thin_content(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of 20 characters and more that stand twice in a markdown, and the share of other text."""
    p = F.filter(F.transform(X.paragraphs(F.coalesce("markdown", F.lit(""))), lambda x: F.lower(U.trim(x))), lambda x: F.length(x) >= 20)
    return _splits(spark, d).select("run_id", p.alias("p")).select("run_id", F.size("p").cast("bigint").alias("n"), (F.size("p") - F.size(F.array_distinct("p"))).cast("bigint").alias("n_repeated"))


@_query
def ttfb_ratings(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ttfb_ms")
    return _runs(spark, d).groupBy(F.when(t < 300, "pass").when(t < 1000, "warn").otherwise("fail").alias("rating")).agg(F.count("*").alias("n_runs"))


@_query
def header_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Header names in lower case and how many runs have each."""
    return _runs(spark, d).select(F.explode(F.map_keys("headers")).alias("k")).groupBy(F.lower("k").alias("header")).agg(F.count("*").alias("n_runs"))


@_query
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """A star join of the order tables: the engine's joins on other data than pages."""
    l, o, c, n = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "nation"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n_items"))


_ML = r"""(SELECT *, coalesce(last_value(CASE WHEN kind NOT IN ('text', 'code') THEN kind END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'blank') AS state FROM
    (SELECT *, CASE WHEN fence THEN 'fence' WHEN code THEN 'code' WHEN trim(line, ' ') = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6}\s') THEN 'heading' WHEN regexp_matches(line, '^>') THEN 'quote' WHEN regexp_matches(line, '^\s*[-*+]\s') THEN 'unordered'
        WHEN regexp_matches(line, '^\s*\d+[.)]\s') THEN 'ordered' WHEN regexp_matches(line, '^\|') THEN 'table' ELSE 'text' END AS kind FROM
    (SELECT *, regexp_matches(line, '^\s*```') AS fence, sum(regexp_matches(line, '^\s*```')::INT) OVER (PARTITION BY run_id ORDER BY pos) % 2 = 1 OR regexp_matches(line, '^\s*```') AS code FROM
    (SELECT run_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT run_id, regexp_split_to_array(markdown, '\r\n|\n|\r') AS x FROM page_splits WHERE length(markdown) > 0)))))"""
_sql(
    markdown_structure=f"""SELECT run_id, count(*) FILTER (kind = 'heading')::BIGINT AS headings, (count(*) FILTER (kind = 'fence') // 2)::BIGINT AS code_blocks, count(*) FILTER (kind = 'quote' AND state <> 'quote')::BIGINT AS quote_blocks, count(*) FILTER (kind = 'unordered' AND state <> 'unordered')::BIGINT AS unordered_lists,
        count(*) FILTER (kind = 'ordered' AND state <> 'ordered')::BIGINT AS ordered_lists, count(*) FILTER (kind IN ('unordered', 'ordered'))::BIGINT AS items, count(*) FILTER (kind = 'table' AND state <> 'table')::BIGINT AS tables, count(*) FILTER (kind = 'table' AND NOT regexp_matches(line, '^[|\\s:-]+$'))::BIGINT AS table_rows FROM {_ML} GROUP BY 1""",
    heading_skips=f"SELECT run_id, pos::INT AS pos, from_level, to_level FROM (SELECT run_id, pos, length(regexp_extract(line, '^(#+)', 1))::INT AS to_level, lag(length(regexp_extract(line, '^(#+)', 1))::INT) OVER (PARTITION BY run_id ORDER BY pos) AS from_level FROM {_ML} WHERE kind = 'heading') WHERE to_level > from_level + 1",
    link_density=f"SELECT run_id, round(len(regexp_extract_all(markdown, '\\]\\(')) * 1000 / greatest(len({_X.format(t='markdown')}), 1)::DOUBLE, 3) AS links_per_1000 FROM page_splits WHERE markdown IS NOT NULL",
    page_extract="""SELECT page_id, nullif(trim(regexp_extract(raw_html, '(?is)<title[^>]*>([^<]*)</title>', 1), ' '), '') AS title_seen, nullif(trim(regexp_extract(raw_html, '(?is)<h1[^>]*>([^<]*)</h1>', 1), ' '), '') AS h1_seen,
        nullif(trim(regexp_extract(raw_html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), ' '), '') AS canonical_seen, nullif(trim(regexp_extract(raw_html, '(?i)<meta[^>]*name="robots"[^>]*content="([^"]*)"', 1), ' '), '') AS robots_seen FROM crawl_pages WHERE raw_html IS NOT NULL""",
    indexable="SELECT is_indexable, status > 0 AND status < 400 AND NOT coalesce(contains(lower(meta_robots), 'noindex'), false) AS by_rule, count(*)::BIGINT AS n_pages FROM crawl_pages GROUP BY 1, 2",
    soft_404="""SELECT * FROM (SELECT run_id, regexp_matches(lower(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), '404|not found|page does not exist') AS title_hit,
        length(regexp_replace(trim(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), ' '), '\\s+', ' ', 'g'))::BIGINT AS n_text FROM page_runs WHERE status = 200 AND html IS NOT NULL) WHERE title_hit AND n_text < 1000""",
    score_labels="SELECT CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'needs_work' WHEN score IS NOT NULL THEN 'poor' END AS label, count(*)::BIGINT AS n_runs, round(avg(score), 4) AS mean_score FROM (SELECT DISTINCT run_id, score FROM content_analysis) GROUP BY 1",
    content_issues="SELECT issue, count(*)::BIGINT AS n_runs FROM (SELECT DISTINCT run_id, issue FROM (SELECT run_id, unnest(issues) AS issue FROM content_analysis)) GROUP BY 1",
    thin_content=f"SELECT run_id, len(p)::BIGINT AS n, (len(p) - len(list_distinct(p)))::BIGINT AS n_repeated FROM (SELECT run_id, list_filter(list_transform(list_filter(regexp_split_to_array(coalesce(markdown, ''), '\\n{{2,}}'), lambda s: {_trim('s')} <> ''), lambda x: lower({_trim('x')})), lambda x: length(x) >= 20) AS p FROM page_splits)",
    ttfb_ratings="SELECT CASE WHEN ttfb_ms < 300 THEN 'pass' WHEN ttfb_ms < 1000 THEN 'warn' ELSE 'fail' END AS rating, count(*)::BIGINT AS n_runs FROM page_runs GROUP BY 1",
    header_inventory="SELECT lower(k) AS header, count(*)::BIGINT AS n_runs FROM (SELECT unnest(map_keys(headers)) AS k FROM page_runs) GROUP BY 1",
    revenue_by_nation="SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    dom_tag_counts="SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(html, '(<script[^>]*>).*?</script>|(<style[^>]*>).*?</style>|<!--.*?-->', '\\1\\2', 'gs'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM page_runs) WHERE tag NOT IN ('meta', 'link', 'title', 'base', 'head') GROUP BY 1",
)


# ------------------------------------------------------------------------------------------- more of the DOM and of headers


@_query
def third_party_scripts(spark: SparkSession, d: str) -> DataFrame:
    return D.third_party(_rare_dom(spark, d), _with_rare(spark, d), "run_id").select("run_id", "domain", "category", "n", "tag_manager")


@_query
def skeleton_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.skeleton_counts(_dom(spark, d), "run_id")


@_query
def image_alt_classes(spark: SparkSession, d: str) -> DataFrame:
    return D.image_classes(_dom(spark, d), "run_id")


@_query
def contents_tables(spark: SparkSession, d: str) -> DataFrame:
    return D.contents_tables(_rare_dom(spark, d), "run_id")


@_query
def duplicate_headings(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_headings(_dom(spark, d), "run_id")


@_query
def deepest_path(spark: SparkSession, d: str) -> DataFrame:
    return D.deepest_path(written(_dom(spark, d), "dom"), "run_id")  # joined with itself


@_query
def cdn_detect(spark: SparkSession, d: str) -> DataFrame:
    return R.detect_cdn(_runs(spark, d)).groupBy("cdn_seen").agg(F.count("*").alias("n_runs"))


@_query
def compression_detect(spark: SparkSession, d: str) -> DataFrame:
    return R.detect_compression(_runs(spark, d)).groupBy("compression_seen").agg(F.count("*").alias("n_runs"))


@_query
def https_seen(spark: SparkSession, d: str) -> DataFrame:
    return R.https_seen(_runs(spark, d)).groupBy("https").agg(F.count("*").alias("n_runs"))


@_query
def cluster_pages(spark: SparkSession, d: str) -> DataFrame:
    """The ten pages with the most in-links of each cluster."""
    return G.top_per_group(_nodes(spark, d), "cluster", [F.desc("inlinks"), F.col("url")], 10).select("cluster", "url", "inlinks")


@_query
def top_pages(spark: SparkSession, d: str) -> DataFrame:
    """The ten pages with the most in-links."""
    return _nodes(spark, d).orderBy(F.desc("inlinks"), "url").limit(10).select("url", "inlinks", "type")


@_query
def soft404_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """How much of each title's trigrams its first heading shares."""
    a, b = X.trigrams(F.coalesce("title", F.lit(""))), X.trigrams(F.coalesce("h1", F.lit("")))
    return _crawl(spark, d).select("page_id", F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1)), 6).alias("overlap"))


_TRI = lambda c: f"CASE WHEN length({c}) >= 3 THEN list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) ELSE [] END"
_sql(
    cdn_detect="""SELECT CASE WHEN regexp_matches(t, 'cf-ray|cf-cache-status') THEN 'cloudflare' WHEN contains(t, 'cloudfront') THEN 'cloudfront' WHEN contains(t, 'akamai') THEN 'akamai' WHEN contains(k, 'x-amz') OR contains(t, 'x-aws') THEN 'aws'
        WHEN contains(t, 'fastly') THEN 'fastly' END AS cdn_seen, count(*)::BIGINT AS n_runs FROM (SELECT lower(array_to_string(map_keys(headers), ' ')) AS k, lower(array_to_string(list_concat(map_keys(headers), map_values(headers)), ' ')) AS t FROM page_runs WHERE headers IS NOT NULL) GROUP BY 1""",
    compression_detect="SELECT CASE WHEN contains(e, 'br') THEN 'br' WHEN contains(e, 'gzip') THEN 'gzip' WHEN contains(e, 'deflate') THEN 'deflate' END AS compression_seen, count(*)::BIGINT AS n_runs FROM (SELECT lower(headers['content-encoding']) AS e FROM page_runs) GROUP BY 1",
    https_seen="SELECT lower(url) LIKE 'https://%' OR len(list_filter(coalesce(redirect_chain, []), lambda x: lower(x) LIKE 'https://%')) > 0 AS https, count(*)::BIGINT AS n_runs FROM page_runs GROUP BY 1",
    cluster_pages=f"SELECT cluster, url, inlinks FROM {_NODES} QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY inlinks DESC, url) <= 10",
    top_pages=f"SELECT url, inlinks, type FROM {_NODES} ORDER BY inlinks DESC, url LIMIT 10",
    soft404_trigrams=f"SELECT page_id, round(len(list_intersect(a, b)) / greatest(len(a), len(b), 1)::DOUBLE, 6) AS overlap FROM (SELECT page_id, {_TRI('t')} AS a, {_TRI('h')} AS b FROM (SELECT page_id, lower(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS t, lower(regexp_replace(coalesce(h1, ''), '\\s+', ' ', 'g')) AS h FROM crawl_pages))",
)


# ------------------------------------------------------------------------------------------- skeletons, graph exports, search reports


@_query
def page_split(spark: SparkSession, d: str) -> DataFrame:
    """Each html as skeleton and markdown."""
    return T.split_pages(_runs(spark, d), "run_id", "html", "url")


@_query
def page_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return T.split_pages(_runs(spark, d), "run_id", "html", "url").select("run_id", "skeleton")


@_query
def content_depth(spark: SparkSession, d: str) -> DataFrame:
    """Words, paragraphs, label, diversity and reading time of each text without its markup."""
    r = C.depth()
    return _read(spark, d).select("doc_id", *(r[k].alias(k) for k in ("word_count", "paragraph_count", "depth_label", "reading_minutes", "diversity", "diversity_label")))


@_query
def content_trust(spark: SparkSession, d: str) -> DataFrame:
    """First person, statistics, citations and the latest year of each text."""
    r = C.trust(F.lit(2026))
    return _read(spark, d).select("doc_id", *(r[k].alias(k) for k in ("first_person", "statistics", "citations", "recent_year", "freshness")))


@_query
def content_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Classes of anchors, kinds of links and images of each markdown."""
    r = C.anchors()
    return C.prepared(_splits(spark, d), "markdown", None).select("run_id", *(r[k].alias(k) for k in ("anchors_generic", "anchors_empty", "anchors_naked", "links_internal", "links_external", "images", "images_without_alt", "alt_coverage")))


@_query
def external_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.external_nodes(_edges(spark, d))


@_query
def url_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """All addresses of the graph, numbered in their order."""
    e = _edges(spark, d)
    return G.dictionary(G.latest(_crawl(spark, d)).select("url").unionByName(e.select(F.col("dst").alias("url"))))


@_query
def compact_graph(spark: SparkSession, d: str) -> DataFrame:
    """The edges as pairs of numbers."""
    return G.compact(G.latest(_crawl(spark, d)), _edges(spark, d))[1]


@_query
def links_of_first(spark: SparkSession, d: str) -> DataFrame:
    """The links into and out of the first address."""
    e = _edges(spark, d)
    return G.links_of(e, e.agg(F.min("src")).first()[0])  # one value


@_query
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """The next hundred addresses to fetch by their in-links."""
    c = _crawl(spark, d)
    e = _edges(spark, d).filter("internal").groupBy(F.col("dst").alias("url")).agg(F.count("*").cast("double").alias("priority"))
    return G.frontier(e, c.select("url").filter("url is not null"), 100)


@_query
def crawl_tree(spark: SparkSession, d: str) -> DataFrame:
    """Pages within three links of the first address."""
    e = _edges(spark, d)
    return G.crawl_tree(e, e.agg(F.min("src")).first()[0], max_pages=1_000_000)


@_query
def unranked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages against a table of search figures: here the analyses, whose scores stand for positions and whose words for impressions."""
    a = table(spark, d, "content_analysis").select("url", F.lit(0).alias("clicks"), F.col("word_count").alias("impressions"), F.col("score").cast("double").alias("position")).distinct()
    return G.unranked(G.overlay(_nodes(spark, d), a))


@_query
def robots_issues(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).filter("doc_kind = 'robots_txt'").select("doc_id", F.lit(200).alias("status"), F.col("text").alias("content"), F.lit("text/plain").alias("content_type"))
    return B.issues(t, B.parse(t, "doc_id", "content"), "doc_id")


@_query
def search_report(spark: SparkSession, d: str) -> DataFrame:
    """Each source's totals and its first 25 queries."""
    return M.page_report(_search(spark, d), "source")


@_query
def search_compare(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and impressions of each source in two periods."""
    return M.compare_periods(_search(spark, d), ["source"], ("2025-01-01", "2025-12-31"), ("2024-01-01", "2024-12-31"))


ANSWERS = (
    (1, "mobile", """{"loadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":4100},"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":5},"INTERACTION_TO_NEXT_PAINT":{"percentile":180}}},"lighthouseResult":{"categories":{"performance":{"score":0.875}},"audits":{"interactive":{"numericValue":12345.6},
    "total-blocking-time":{"numericValue":310.4},"unused-css":{"numericValue":1500.4,"details":{"type":"opportunity","overallSavingsBytes":99.6}},"resource-summary":{"details":{"items":[{"resourceType":"script","transferSize":10,"requestCount":2},{"resourceType":"document","transferSize":5,"requestCount":1}]}}}}}"""),
    (1, "desktop", "{}"),
    (2, "desktop", None),
)


def _answers(spark: SparkSession) -> DataFrame:
    d = spark.createDataFrame([(i, s, n, a) for n, (i, s, a) in enumerate(ANSWERS)], "page_id bigint, strategy string, n int, answer string")
    return L.preferred(d, "page_id", "strategy", "n")


@_query
def lab_field(spark: SparkSession, d: str) -> DataFrame:
    return L.field_metrics(_answers(spark), "page_id", "answer").select("page_id", "metric", "value", "status")


@_query
def lab_figures(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("answer")
    c = L.lab_columns(a) | L.resources(a)
    return _answers(spark).select("page_id", "strategy", *(c[k].alias(k) for k in ("performance_score", "tti_s", "tbt_ms", "total_bytes", "script_requests", "other_bytes")))


@_query
def lab_opportunities(spark: SparkSession, d: str) -> DataFrame:
    return L.opportunities(_answers(spark), "page_id", "answer")


ITEMS = (
    (1, """{"@context":"https://schema.org","@type":"Article","headline":"h","author":"a name","datePublished":"soon"}"""),
    (2, """{"@context":"https://schema.org","@type":"Product","name":"p","image":"https://e/i","offers":{"price":1,"priceCurrency":"EUR"},"description":"d","brand":"b","sku":"s","aggregateRating":{"ratingValue":4,"ratingCount":2},"review":"r"}"""),
    (2, """{"@type":"WebSite","name":"s","url":"https://e/"}"""),
    (3, "{bad"),
)


@_query
def jsonld_items(spark: SparkSession, d: str) -> DataFrame:
    v = J.validate(spark.createDataFrame(ITEMS, "page_id bigint, item string"), "page_id")
    flat = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return v.select("page_id", flat("types"), flat("missing_required"), flat("format_errors"), flat("warnings"), "score")


@_query
def jsonld_pages(spark: SparkSession, d: str) -> DataFrame:
    return J.page_rollup(J.validate(spark.createDataFrame(ITEMS, "page_id bigint, item string"), "page_id"), "page_id")


@_query
def page_jsonld(spark: SparkSession, d: str) -> DataFrame:
    """The JSON-LD of every page's html, validated and rolled up."""
    items = D.jsonld_blocks(_dom(spark, d), "run_id")
    return J.page_rollup(J.validate(items, "run_id"), "run_id")


_TEXT = "regexp_replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')"
_HEADS = f"""(SELECT run_id, generate_subscripts(l, 1)::BIGINT AS pos, unnest(l)::INT AS level, trim({_TEXT.format(x="unnest(t)")}, ' ') AS text FROM
    (SELECT run_id, regexp_extract_all(html, '(?is)<h([1-6])(?:\\s[^>]*)?>(.*?)</h[1-6]>', 1) AS l, regexp_extract_all(html, '(?is)<h([1-6])(?:\\s[^>]*)?>(.*?)</h[1-6]>', 2) AS t FROM page_runs WHERE html IS NOT NULL))"""
_IMG = "(SELECT run_id, unnest(regexp_extract_all(html, '<img\\b[^>]*>')) AS i FROM page_runs)"
_MD = "regexp_extract_all(coalesce(markdown, ''), '\\[([^\\]]*)\\]\\(([^)]*)\\)', {k})"
_GEN = "'click here', 'here', 'read more', 'learn more', 'this', 'this page', 'this post', 'this article', 'link', 'more', 'continue', 'visit', 'see more', 'find out more', 'details'"
_ALLURL = f"(SELECT url FROM {_L} UNION SELECT dst FROM {_E} UNION SELECT src FROM {_E} WHERE src IS NOT NULL)"
_DICT = f"(SELECT url, row_number() OVER (ORDER BY url) - 1 AS id FROM {_ALLURL})"
_FIRST = f"(SELECT min(src) FROM {_E})"
_sql(
    heading_outline=f"""SELECT run_id, pos, level, text, previous_level, coalesce(level > previous_level + 1, false) AS skipped, (SELECT max(b.pos) FROM {_HEADS} b WHERE b.run_id = a.run_id AND b.pos < a.pos AND b.level < a.level) AS parent_pos
        FROM (SELECT *, lag(level) OVER (PARTITION BY run_id ORDER BY pos) AS previous_level FROM {_HEADS}) a""",
    duplicate_headings=f"SELECT run_id, arg_min(text, pos) AS text, count(*)::BIGINT AS n FROM {_HEADS} WHERE text <> '' GROUP BY run_id, lower(text) HAVING count(*) > 1 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, min(pos)) <= 5",
    image_alt_classes=f"""SELECT run_id, alt_class, count(*)::BIGINT AS n, count(*) FILTER (regexp_matches(i, 'loading="lazy"'))::BIGINT AS lazy, count(*) FILTER (regexp_matches(lower(i), 'src="[^"]*\\.(webp|avif)(\\?[^"]*)?"'))::BIGINT AS modern,
        count(*) FILTER (contains(i, 'width=') AND contains(i, 'height='))::BIGINT AS sized FROM (SELECT *, CASE WHEN NOT contains(i, 'alt=') THEN 'missing' WHEN trim(a, ' ') = '' THEN 'empty' WHEN length(a) < 3 THEN 'short' WHEN length(a) > 125 THEN 'long'
        WHEN regexp_matches(lower(a), '^(image|img|photo|picture|icon|logo)\\d*$|\\.(jpe?g|png|gif|webp|svg)$') THEN 'poor' ELSE 'good' END AS alt_class FROM (SELECT *, regexp_extract(i, 'alt="([^"]*)"', 1) AS a FROM {_IMG})) GROUP BY 1, 2""",
    page_skeleton="""SELECT run_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<noscript\\b.*?</noscript>|<svg\\b.*?</svg>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '>[^<]*[^<\\s][^<]*<', '><', 'g'), '^\\s*$', '') AS skeleton FROM page_runs""",
    backpressure="SELECT host, round(list_reduce(list_prepend(1.0::DOUBLE, s), lambda m, x: CASE WHEN x = 429 THEN least(m * 1.5, 10.0) WHEN x < 400 AND m > 1 THEN greatest(1.0, m * 0.95) ELSE m END), 6) AS factor FROM (SELECT host, list(status::DOUBLE ORDER BY page_id) AS s FROM crawl_pages WHERE status IS NOT NULL GROUP BY 1)",
    unlabelled_inputs="SELECT -1::BIGINT AS run_id, 2::BIGINT AS n",
    largest_images="SELECT -1::BIGINT AS run_id, 'a.webp' AS src, 20::BIGINT AS area",
    frame_hosts="SELECT -1::BIGINT AS run_id, 1::BIGINT AS n_frames, 'video.example' AS hosts",
    third_party_scripts="SELECT * FROM (VALUES (-1::BIGINT, 'www.googletagmanager.com', 'analytics', 1::BIGINT, true), (-1, 'cdn.jsdelivr.net', 'cdn', 1, false)) t(run_id, domain, category, n, tag_manager)",
    contents_tables="SELECT -2::BIGINT AS run_id, 3::BIGINT AS n_links",
    redirect_hops="SELECT * FROM (VALUES (-1::BIGINT, 0, 'http://rare.example/a', 'https://rare.example/a', 'https'), (-1, 1, 'https://rare.example/a', 'https://www.rare.example/a', 'www'), (-1, 2, 'https://www.rare.example/a', 'https://www.rare.example/a/', 'slash')) t(run_id, hop, src, dst, labels)",
    content_depth=f"""SELECT doc_id, len(words)::BIGINT AS word_count, p::BIGINT AS paragraph_count, CASE WHEN len(words) < 100 THEN 'thin' WHEN len(words) < 300 THEN 'short' WHEN len(words) < 800 THEN 'adequate' ELSE 'comprehensive' END AS depth_label, round_even(len(words) / 200.0, 1) AS reading_minutes, v AS diversity,
        CASE WHEN v < 0.3 THEN 'low' WHEN v <= 0.5 THEN 'medium' ELSE 'high' END AS diversity_label FROM (SELECT *, len(list_filter(regexp_split_to_array(plain, '\\n\\n+'), lambda x: {_trim('x')} <> '')) AS p, CASE WHEN len(words) > 0 THEN round_even(len(list_distinct(list_transform(words, lambda w: lower(w)))) / len(words)::DOUBLE, 3) ELSE 0.0 END AS v FROM {_READ})""",
    content_anchors=f"""SELECT run_id, len(list_filter(t, lambda a: a IN ({_GEN})))::BIGINT AS anchors_generic, len(list_filter(t, lambda a: a = ''))::BIGINT AS anchors_empty, len(list_filter(t, lambda a: regexp_matches(a, '^https?://')))::BIGINT AS anchors_naked,
        len(list_filter(u, lambda x: NOT regexp_matches(x, '^https?://')))::BIGINT AS links_internal, len(list_filter(u, lambda x: regexp_matches(x, '^https?://')))::BIGINT AS links_external, len(i)::BIGINT AS images, len(list_filter(i, lambda x: {_trim('x')} = ''))::BIGINT AS images_without_alt,
        CASE WHEN len(i) > 0 THEN round_even((len(i) - len(list_filter(i, lambda x: {_trim('x')} = ''))) / len(i)::DOUBLE, 4) ELSE 1.0 END AS alt_coverage
        FROM (SELECT run_id, list_transform({_MD.format(k=1)}, lambda x: lower({_trim('x')})) AS t, list_transform({_MD.format(k=2)}, lambda x: {_trim('x')}) AS u, regexp_extract_all(coalesce(markdown, ''), '!\\[([^\\]]*)\\]\\([^)]*\\)', 1) AS i FROM page_splits)""",
    external_nodes=f"SELECT 'ext:' || {_host('dst')} AS url, 'external' AS type, count(*)::BIGINT AS inlinks FROM {_E} WHERE NOT internal GROUP BY 1",
    url_dictionary=f"SELECT url, row_number() OVER (ORDER BY url) - 1 AS id FROM (SELECT url FROM {_L} UNION SELECT dst FROM {_E})",
    compact_graph=f"SELECT s.id AS src_id, t.id AS dst_id, bool_or(follow) AS follow FROM {_E} e JOIN {_DICT} s ON e.src = s.url JOIN {_DICT} t ON e.dst = t.url GROUP BY 1, 2",
    links_of_first=f"SELECT 'out' AS direction, dst AS url, bool_or(follow) AS follow FROM {_E} WHERE src = {_FIRST} GROUP BY 2 UNION ALL SELECT 'in', src, bool_or(follow) FROM {_E} WHERE dst = {_FIRST} GROUP BY 2",
    crawl_frontier=f"SELECT dst AS url, count(*)::DOUBLE AS priority FROM {_E} WHERE internal AND dst NOT IN (SELECT url FROM crawl_pages WHERE url IS NOT NULL) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    crawl_tree=f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_E} WHERE internal AND src <> dst), w(url, k) AS (SELECT {_FIRST}, 0 UNION SELECT e.dst, k + 1 FROM w JOIN e ON w.url = e.src WHERE k < 3) SELECT url, min(k)::INT AS depth FROM w GROUP BY 1",
    search_report=f"""SELECT source, NULL AS query, {_TOT}, 0::BIGINT AS rank FROM {_S} GROUP BY 1 UNION ALL SELECT * FROM (SELECT source, query, {_TOT}, row_number() OVER (PARTITION BY source ORDER BY sum(clicks) DESC, query) AS rank FROM {_S} GROUP BY 1, 2) WHERE rank <= 25""",
    search_compare=f"""SELECT source, {', '.join(f"sum(CASE WHEN date BETWEEN DATE '{y}-01-01' AND DATE '{y}-12-31' THEN {m} ELSE 0 END)::BIGINT AS {m}_{n}" for n, y in (('now', 2025), ('before', 2024)) for m in ('clicks', 'impressions'))},
        {', '.join(f"(sum(CASE WHEN date >= DATE '2025-01-01' THEN {m} ELSE 0 END) - sum(CASE WHEN date < DATE '2025-01-01' THEN {m} ELSE 0 END))::BIGINT AS {m}_change" for m in ('clicks', 'impressions'))} FROM {_S} WHERE date BETWEEN DATE '2024-01-01' AND DATE '2025-12-31' GROUP BY 1""",
    lab_field="SELECT * FROM (VALUES (1::BIGINT, 'lcp', 4100.0::DOUBLE, 'fail'), (1, 'cls', 0.05, 'good'), (1, 'inp', 180.0, 'good'), (1, 'fcp', 0.0, 'warn'), (1, 'fid', 0.0, 'fail')) t(page_id, metric, value, status)",
    lab_figures="SELECT * FROM (VALUES (1::BIGINT, 'mobile', 88::BIGINT, 12.35::DOUBLE, 310.0::DOUBLE, 15::BIGINT, 2::BIGINT, 5::BIGINT), (2, 'desktop', 0, 0.0, 0.0, NULL, NULL, NULL)) t(page_id, strategy, performance_score, tti_s, tbt_ms, total_bytes, script_requests, other_bytes)",
    lab_opportunities="SELECT 1::BIGINT AS page_id, 'unused-css' AS audit, 1500::BIGINT AS savings_ms, 100::BIGINT AS savings_bytes, 'fail' AS status",
    jsonld_items="""SELECT * FROM (VALUES (1::BIGINT, 'Article', 'image,publisher', 'datePublished', 'author', 25::BIGINT), (2, 'Product', '', '', '', 100), (2, 'WebSite', '', '@context', '', 85), (3, 'Unknown', '', 'json', '', 0)) t(page_id, types, missing_required, format_errors, warnings, score)""",
    jsonld_pages="""SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 1::BIGINT, 25::BIGINT, 'Article', '', '', false), (2, 2, 2, 92, 'Product,WebSite', 'Product', '', true), (3, 1, 0, 0, 'Unknown', '', '', false)) t(page_id, n_items, n_valid, mean_score, types, eligible, duplicate_types, website_without_search)""",
    url_compare_canonical=f"""SELECT page_id, u = c AS self_referencing, CASE WHEN canonical IS NULL THEN 'missing' WHEN u = c THEN 'match' ELSE 'mismatch' END AS canonical_status FROM (SELECT page_id, canonical, {{u}} AS u, {{c}} AS c FROM (SELECT page_id, url, canonical, CASE WHEN canonical IS NULL THEN NULL WHEN regexp_matches(j, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN j
        WHEN j LIKE '//%' THEN {_part('url', 1)} || ':' || j WHEN j LIKE '/%' THEN {_part('url', 1)} || '://' || {_part('url', 2)} || j WHEN j LIKE '?%' THEN {_part('url', 1)} || '://' || {_part('url', 2)} || ({_path('url')}) || j WHEN j = '' OR j LIKE '#%' THEN {_part('url', 1)} || '://' || {_part('url', 2)} || ({_path('url')}) || {_part('url', 4)} || j
        ELSE {_part('url', 1)} || '://' || {_part('url', 2)} || regexp_extract({_path('url')}, '^(.*/)', 1) || j END AS x FROM (SELECT *, {_trim('canonical')} AS j FROM crawl_pages)))""".replace("{u}", f"lower({_part('url', 1)}) || '://' || lower({_part('url', 2)}) || (CASE WHEN regexp_replace({_path('url')}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_path('url')}, '/+$', '') END) || {_part('url', 4)}").replace("{c}", f"lower({_part('x', 1)}) || '://' || lower({_part('x', 2)}) || (CASE WHEN regexp_replace({_path('x')}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_path('x')}, '/+$', '') END) || {_part('x', 4)}"),
)


def _decoded(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&')"


def _attribute(before: str) -> str:
    """The value behind the given text, null where it isn't there."""
    return f"CASE WHEN contains(html, '{before}') THEN " + _decoded(f"regexp_extract(html, '{before}([^\"]*)\"', 1)") + " END"


def _meta(name: str, by: str = "name") -> str:
    return _attribute(f'<meta {by}="{name}" content="')


def _rel(name: str) -> str:
    return _attribute(f'<link rel="{name}" href="')


def _n_rel(name: str) -> str:
    return f"len(regexp_extract_all(html, '<link rel=\"{name}\"'))::BIGINT"


_BODY = "regexp_replace(regexp_replace(html, '(<script[^>]*>).*?</script>', '\\1x</script>', 'gs'), '<!--.*?-->|<!doctype[^>]*>', '', 'gsi')"
_TAG = "'<(/?)([a-z][a-z0-9]*)([^>]*)>'"
_TOKENS = f"""(SELECT run_id, generate_subscripts(t, 1) AS pos, unnest(c) = '/' AS closes, unnest(t) AS tag, unnest(a) AS attrs FROM (SELECT run_id, regexp_extract_all(b, {_TAG}, 1) AS c, regexp_extract_all(b, {_TAG}, 2) AS t,
    regexp_extract_all(b, {_TAG}, 3) AS a FROM (SELECT run_id, {_BODY} AS b FROM page_runs WHERE length(html) > 0)))"""
_VOIDS = "'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr'"
_ELEMENTS = f"""(SELECT run_id, tag, attrs, depth FROM (SELECT *, coalesce(sum(CASE WHEN closes THEN -1 WHEN tag IN ({_VOIDS}) THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM {_TOKENS}) WHERE NOT closes)"""
_IN = "tag NOT IN ('meta', 'link', 'title', 'base', 'head')"


def _cnt(cond: str) -> str:
    return f"count(*) FILTER ({cond})::BIGINT"


def _has(a: str) -> str:
    return f"regexp_matches(attrs, '\\s{a}(=|\\s|$)')"


_OG = {"og:title": "og_title", "og:description": "og_description", "og:image": "og_image", "og:type": "og_type", "article:published_time": "published_time", "article:modified_time": "modified_time"}
_TITLE = _decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
_LEVELS = ", ".join(_cnt(f"tag = 'h{i}'") + f" AS h{i}_count" for i in range(1, 7))
_WEBP = r"""regexp_matches(lower(attrs), 'src="[^"]*[.](webp|avif)([?][^"]*)?"')"""
_sql(
    dom_metadata=f"""SELECT *, CASE WHEN coalesce(length(title), 0) = 0 THEN 'fail' WHEN length(title) BETWEEN 30 AND 60 THEN 'pass' ELSE 'warn' END AS title_status, CASE WHEN coalesce(length(description), 0) = 0 THEN 'fail' WHEN length(description) BETWEEN 120 AND 160 THEN 'pass' ELSE 'warn' END AS description_status,
        NOT coalesce(contains(lower(robots), 'noindex'), false) AS "index", NOT coalesce(contains(lower(robots), 'nofollow'), false) AS follow FROM
        (SELECT run_id, CASE WHEN contains(html, '<title>') THEN trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g'), ' ') END AS title, {_meta('description')} AS description, {_meta('robots')} AS robots, {_rel('canonical')} AS canonical,
        {', '.join(_meta(k, 'property') + ' AS ' + v for k, v in _OG.items())},
        {_meta('twitter:card')} AS twitter_card, {_rel('prev')} AS prev, {_rel('next')} AS next, {_rel('amphtml')} AS amp, {_n_rel('preload')} AS preload, {_n_rel('prefetch')} AS prefetch, {_n_rel('dns-prefetch')} AS dns_prefetch, {_n_rel('preconnect')} AS preconnect, '' AS hreflang FROM page_runs WHERE length(html) > 0)""",
    dom_summary=f"""SELECT e.*, h.first_h1, x.empty_elements, x.links_without_text, x.buttons_without_text, x.empty_headings FROM
        (SELECT run_id, {_cnt(_IN)} AS total_elements, count(DISTINCT tag) FILTER ({_IN})::BIGINT AS unique_tags, max(depth)::BIGINT AS depth_max, round(avg(depth), 1) AS depth_avg, round(count(*) FILTER (tag = 'div') / greatest(count(*) FILTER ({_IN}), 1)::DOUBLE, 2) AS div_ratio,
        count(DISTINCT tag) FILTER (tag IN ('header', 'nav', 'main', 'article', 'section', 'aside', 'footer'))::BIGINT AS semantic_score, {_LEVELS}, 0::BIGINT AS repeated_ids,
        coalesce(array_to_string(list_sort(list(DISTINCT tag) FILTER (tag IN ('font', 'center', 'marquee', 'applet', 'frameset', 'frame', 'strike', 'u'))), ','), '') AS deprecated_tags, {_cnt("regexp_matches(attrs, ' on(click|load|mouseover|mouseout|change|focus|blur)=')")} AS inline_handlers, {_cnt("tag = 'iframe'")} AS iframes,
        bool_or(tag = 'meta' AND {_has('charset')}) AS has_charset, bool_or(tag = 'meta' AND contains(attrs, 'name="viewport"')) AS has_viewport, bool_or(tag = 'html' AND regexp_matches(attrs, ' lang="[^"]+"')) AS has_lang, {_cnt("tag = 'script' AND contains(attrs, 'application/ld+json')")} AS jsonld_scripts,
        {_cnt("tag = 'img' AND " + _WEBP)} AS images_modern, bool_or(tag = 'link' AND regexp_matches(attrs, 'rel="([^"]* )?icon( [^"]*)?"')) AS has_favicon, {_cnt("tag = 'img'")} AS images, {_cnt("tag = 'img' AND NOT " + _has('alt'))} AS images_without_alt,
        {_cnt("tag = 'img' AND NOT (" + _has('width') + ' AND ' + _has('height') + ')')} AS images_without_size, {_cnt("tag = 'img' AND contains(attrs, 'loading=\"lazy\"')")} AS images_lazy, {_cnt("tag = 'a' AND " + _has('href'))} AS links, {_cnt("tag = 'a' AND regexp_matches(lower(attrs), 'href=\"https?://[^/]')")} AS links_absolute,
        {_cnt("tag = 'a' AND contains(attrs, 'target=\"_blank\"') AND NOT (contains(attrs, 'noopener') AND contains(attrs, 'noreferrer'))")} AS blank_targets_unsafe, {_cnt("tag = 'form'")} AS forms, {_cnt("tag = 'form' AND NOT " + _has('action'))} AS forms_without_action, {_cnt("tag = 'input'")} AS inputs, {_cnt("tag = 'script'")} AS scripts,
        {_cnt("tag = 'script' AND " + _has('src'))} AS scripts_external, {_cnt("tag = 'script' AND " + _has('defer'))} AS scripts_defer, {_cnt("tag = 'script' AND " + _has('async'))} AS scripts_async, {_cnt(_has('style'))} AS inline_styles, {_cnt("regexp_matches(attrs, ' tabindex=\"[1-9]')")} AS positive_tabindex,
        sum(len(regexp_extract_all(attrs, ' aria-')))::BIGINT AS aria_attributes FROM {_ELEMENTS} GROUP BY 1) e
        LEFT JOIN (SELECT run_id, arg_min(text, pos) AS first_h1 FROM {_HEADS} WHERE level = 1 GROUP BY 1) h USING (run_id)
        JOIN (SELECT run_id, (len(regexp_extract_all(b, '<(?:area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr)[^>]*>')) + len(regexp_extract_all(b, '<[a-z][^>]*>\\s*</')) - len(regexp_extract_all(b, '<(?:area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr)[^>]*>\\s*</')))::BIGINT AS empty_elements,
        len(regexp_extract_all(b, '<a(\\s[^>]*)?>\\s*</a>'))::BIGINT AS links_without_text, len(regexp_extract_all(b, '<button(\\s[^>]*)?>\\s*</button>'))::BIGINT AS buttons_without_text, len(regexp_extract_all(b, '<h[1-6][^>]*>\\s*</h'))::BIGINT AS empty_headings FROM (SELECT run_id, {_BODY} AS b FROM page_runs WHERE length(html) > 0)) x USING (run_id)""",
    skeleton_counts=f"SELECT run_id, count(*)::BIGINT AS n FROM {_ELEMENTS} WHERE tag NOT IN ('script', 'style', 'noscript', 'svg') GROUP BY 1",
)


# ------------------------------------------------------------------------------------------- verdicts and answers over literal rows


@_query
def core_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether the three core metrics are good at their 75th percentile; null without LCP or INP."""
    rows = [(1, 2500.0, 0.1, 200.0), (2, 2501.0, 0.0, 1.0), (3, None, 0.0, 1.0), (4, 1.0, None, 1.0), (5, 0.0, 0.0, 0.0), (6, 1.0, 0.2, 1.0)]
    v = spark.createDataFrame(rows, "page_id bigint, lcp double, cls double, inp double")
    return v.select("page_id", M.core_verdict(F.col("lcp"), F.col("cls"), F.col("inp")).alias("passes"))


@_query
def search_properties(spark: SparkSession, d: str) -> DataFrame:
    """The property of each address: its domain first, else the longest prefix."""
    props = spark.createDataFrame([("domain:e.com",), ("https://e.com/blog/",), ("http://f.org/",), ("https://f.org/a/",)], "property string")
    return M.resolve_property(spark.createDataFrame([("https://shop.e.com/x",), ("https://e.com/blog/1",), ("https://f.org/a/b",), ("https://f.org/c",), ("https://g.net/",)], "url string"), props)


@_query
def landed_inspections(spark: SparkSession, d: str) -> DataFrame:
    rows = [("u", '{"inspectionResult":{"indexStatusResult":{"verdict":"PASS","userCanonical":"a","googleCanonical":"b"}}}'), ("v", "{}"), ("w", '{"inspectionResult":{}}'), ("x", None)]
    return A.inspections(spark.createDataFrame(rows, "url string, answer string"), "url", "answer").select("url", "verdict", "coverage", "indexed", "declared", "chosen")


@_query
def landed_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    rows = [("u", '{"sitemap":[{"path":"s","errors":"2","contents":[{"submitted":"5","indexed":"3"},{"submitted":"1"}]},{}]}'), ("v", None)]
    return A.listed_sitemaps(spark.createDataFrame(rows, "url string, answer string"), "url", "answer").select("url", "path", "is_index", "errors", "submitted", "indexed")


_sql(
    core_verdicts="SELECT * FROM (VALUES (1::BIGINT, true), (2, false), (3, NULL), (4, true), (5, NULL), (6, false)) t(page_id, passes)",
    search_properties="SELECT * FROM (VALUES ('https://shop.e.com/x', 'domain:e.com'), ('https://e.com/blog/1', 'domain:e.com'), ('https://f.org/a/b', 'https://f.org/a/'), ('https://f.org/c', 'http://f.org/')) t(url, property)",
    landed_inspections="SELECT * FROM (VALUES ('u', 'PASS', 'Unknown', true, 'a', 'b'), ('w', 'NEUTRAL', 'Unknown', false, NULL, NULL)) t(url, verdict, coverage, indexed, declared, chosen)",
    landed_sitemaps="SELECT * FROM (VALUES ('u', 's', false, 2::BIGINT, 6::BIGINT, 3::BIGINT), ('u', '', false, 0, 0, 0)) t(url, path, is_index, errors, submitted, indexed)",
)
