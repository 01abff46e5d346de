import json

import pytest
from pyspark.sql import functions as F

from loomwright.functions import texts as X, urls as U
from loomwright.operators import dom as D, graph as G, jsonld as J, metrics as M, report as R, robots as B
from loomwright.plans import catalog
from loomwright.sources import readers, writers
from loomwright.streaming import flows as S


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'bigint'}" for k, v in values.items())).select(col).first()[0]


@pytest.mark.parametrize(
    ("url", "href", "same"),
    [
        ("https://example.com/foo", "https://example.com/foo", True), ("https://example.com/foo", "/foo", True), ("https://example.com/foo/", "https://example.com/foo", True),
        ("https://Example.com/foo", "https://example.com/foo", True), ("http://example.com/foo", "https://example.com/foo", False), ("https://example.com/foo", "https://example.com/bar", False), ("https://example.com/foo", None, None),
    ],
)
def test_canonical(spark, url, href, same):
    assert one(spark, U.comparable(F.col("u")) == U.comparable(U.join(F.col("u"), F.col("h"))), u=url, h=href) is same


def test_url_parts(spark):
    assert one(spark, U.normalize(F.col("u")), u="HTTPS://Ex.com/a?utm_source=x&b=1&ref=q#top") == "https://ex.com/a?b=1"
    assert one(spark, U.normalize(F.col("u")), u="https://ex.com/a.PDF") is None
    assert one(spark, U.first_segment(F.col("u")), u="https://ex.com") == "root"
    assert one(spark, U.is_private_host(F.col("h")), h="172.20.1.1") and not one(spark, U.is_private_host(F.col("h")), h="example.com")
    assert one(spark, F.col("p").rlike(U.glob_pattern("/a/*/c")), p="/a/b/c") and not one(spark, F.col("p").rlike(U.glob_pattern("/a/*/c")), p="/a/b/d/c")


def test_texts(spark):
    assert one(spark, X.nearest_rank(F.array(*map(F.lit, (1, 2, 3, 4))), 0.5), x="") == 3
    assert one(spark, X.nearest_rank(F.array().cast("array<int>"), 0.5), x="") is None
    assert one(spark, X.content_hash(F.col("t")), t="ab") == 3105
    assert one(spark, F.size(X.words(F.col("t"))), t="café déjà 2x_y") == 3
    assert one(spark, X.strip_markdown(F.col("t")), t="# T\n**b** [l](x)") == "T\nb l"


def robots(spark, rules, path):
    r = spark.createDataFrame([("h", "*", k, v) for k, v in rules], "host string, agent string, kind string, value string")
    return B.verdicts(spark.createDataFrame([("h", path)], "host string, path string"), r, ("googlebot",)).first()["allowed"]


@pytest.mark.parametrize(
    ("path", "dis", "allow", "disallowed"),
    [
        ("/folder/page.html", "/folder/", "/folder/page.html", False), ("/folder/other.html", "/folder/", "/folder/page.html", True), ("/a/b/c", "/a/b/c", "/a/", True), ("/foo", "/foo", "/foo", False),
        ("/unrelated", "/admin", None, False), ("/anything", "", None, False), ("/x/y/z.pdf", "/*.pdf", None, True), ("/foo/bar.pdfx", "/*.pdf$", None, False), ("/search", "/search?*", None, False), ("/search?q", "/search?*", None, True),
    ],
)
def test_robots_longest_match(spark, path, dis, allow, disallowed):
    assert robots(spark, [("disallow", dis)] + ([("allow", allow)] if allow else []), path) is not disallowed


def test_robots_parser(spark):
    txt = "﻿User-agent: A\nUser-agent: b # c\n\nDisallows: /x\nUser-agent: *\nCrawl-delay: z\nfoo: 1\nSitemap: https://e/s.xml"
    rows = B.parse(spark.createDataFrame([(1, txt), (2, None), (3, "")], "id bigint, t string"), "id", "t").collect()
    assert {(r.agent, r.kind, r.value, r.warning) for r in rows} == {("a", "disallow", "/x", "misspelt"), ("b", "disallow", "/x", "misspelt"), ("*", "crawl-delay", "z", "not a number"), ("*", "foo", "1", "unknown"), ("*", "sitemap", "https://e/s.xml", None)}


def graph(spark, pairs):
    e = spark.createDataFrame([(a, b, True, True) for a, b in pairs], "src string, dst string, follow boolean, internal boolean")
    n = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "url string")
    return n, e


def test_pagerank_fixtures(spark):
    n, e = graph(spark, [("a", "b"), ("b", "a")])
    assert {r.page_rank for r in G.pagerank(n, e).collect()} == {1.0}
    n, e = graph(spark, [("a", "b")])
    assert {r.url: r.page_rank for r in G.pagerank(n, e).collect()} == {"a": 0.5405, "b": 1.0}
    assert G.pagerank(n.limit(0), e).count() == 0


def test_link_depth_with_a_cycle(spark):
    n, e = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")])
    assert {r.url: r.link_depth for r in G.link_depth(n, e, n.filter("url = 'a'")).collect()} == {"a": 0, "b": 1, "c": 2}


def test_link_depth_has_no_bound(spark):
    n, e = graph(spark, [(f"p{i}", f"p{i + 1}") for i in range(53)])
    assert {r.url: r.link_depth for r in G.link_depth(n, e, n.filter("url = 'p0'")).collect()} == {f"p{i}": i for i in range(54)}


def test_all_depths_equal_a_plain_search(spark, data):
    pages, links = {}, {}
    for r in spark.read.parquet(f"{data}/crawl_pages.parquet").select("url", "page_id", "crawl_depth").filter("url is not null").orderBy("page_id").collect():
        pages[r.url] = r.crawl_depth
    for r in catalog.QUERIES["link_edges"](spark, data).filter("internal").collect():
        links.setdefault(r.src, []).append(r.dst)
    want = {u: 0 for u, c in pages.items() if c is not None and c <= 1}
    todo = list(want)
    for u in todo:
        for v in links.get(u, []):
            if v in pages and v not in want:
                want[v] = want[u] + 1
                todo.append(v)
    got = {r.url: (r.link_depth, r.reached) for r in catalog.QUERIES["link_depth"](spark, data).collect()}
    assert got == {u: (want.get(u, c), u in want) for u, c in pages.items()}


def test_dom_rules(spark):
    html = "<html lang=en><head><meta charset=utf-8><title>T</title></head><body><div><p>a<p>b<b>c</div><img src=x><img src=y alt=''><script>var p='</p>';</script><label>n <input></label><input id=q><label for=q>q</label><input></body></html>"
    dom = D.dom_nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "page bigint, html string"), "page", "html").cache()
    s = D.summary(dom, "page").first()
    assert (s.images, s.images_without_alt, s.scripts, s.has_lang, s.has_charset) == (2, 1, 1, True, True)
    assert D.unlabelled_inputs(dom, "page").count() == 1
    assert D.metadata(dom, "page").first().title == "T"
    assert dom.select("page").distinct().count() == 1


def test_heading_outline(spark):
    dom = D.dom_nodes(spark.createDataFrame([(1, "<h1>a</h1><h3>b</h3><h2>c</h2><h3>d</h3>")], "p bigint, h string"), "p", "h")
    rows = D.headings(dom, "p").orderBy("node_id").collect()
    assert [(r.level, r.skipped, r.parent_id) for r in rows] == [(1, False, None), (3, True, 0), (2, False, 0), (3, False, 2)]


ARTICLE = {"@context": "https://schema.org", "@type": "Article", "headline": "h", "image": "https://e/i.png", "author": {"@type": "Person", "name": "n"}, "datePublished": "2024-01-02", "publisher": {"@type": "Organization", "name": "p", "logo": "https://e/l"}, "dateModified": "2024-01-03", "mainEntityOfPage": "https://e/", "description": "d", "inLanguage": "en"}


@pytest.mark.parametrize(
    ("drop", "more", "score"),
    [
        ((), {}, 100), (("headline",), {}, 80), (("description", "inLanguage"), {}, 90), ((), {"datePublished": "soon"}, 90), ((), {"image": "/i.png"}, 90), ((), {"image": ["https://e/a", {"@type": "ImageObject"}]}, 100),
        ((), {"author": "a name"}, 95), ((), {"author": [{"@type": "Person", "name": "a"}, "b"]}, 95), ((), {"publisher": {"@type": "Organization", "name": "p"}}, 95), ((), {"@context": "http://schema.org/"}, 95), ((), {"@context": ["x", "https://schema.org"]}, 100),
        ((), {"@context": "https://other.example"}, 90), (("@context",), {}, 90), ((), {"aggregateRating": {"ratingValue": 7, "ratingCount": 2}}, 95), ((), {"aggregateRating": {"ratingValue": "4.5"}}, 95), ((), {"offers": [{"price": 3, "priceCurrency": "eur"}]}, 95),
        ((), {"offers": {"name": "o"}}, 90), ((), {"reviewRating": {"bestRating": 5}}, 95), (("headline", "image", "author", "datePublished", "publisher"), {}, 0), ((), {"duration": "PT1H30M"}, 100), ((), {"duration": "an hour"}, 90),
    ],
)
def test_jsonld_score(spark, drop, more, score):
    item = {k: v for k, v in ARTICLE.items() if k not in drop} | more
    assert J.validate(spark.createDataFrame([(1, json.dumps(item))], "id bigint, item string"), "id").first().score == score


def test_jsonld_of_pages(spark):
    shop = {"@context": "https://schema.org", "@type": "Product", "name": "p", "image": "https://e/i", "offers": {"price": 1, "priceCurrency": "EUR"}}
    site = {"@context": "https://schema.org", "@type": "WebSite", "name": "s", "url": "https://e/"}
    crumbs = {"@context": "https://schema.org", "@type": ["BreadcrumbList"], "itemListElement": [{"a": 1}]}
    rows = [(1, shop), (1, shop), (1, site), (2, crumbs), (2, shop | {"@id": "a"}), (2, shop | {"@id": "b"})]
    df = spark.createDataFrame([(p, json.dumps(x)) for p, x in rows] + [(3, "{bad"), (4, None)], "id bigint, item string")
    pages = {r.id: r for r in J.page_rollup(J.validate(df, "id"), "id").collect()}
    assert set(pages) == {1, 2, 3} and (pages[3].n_items, pages[3].n_valid, pages[3].mean_score, pages[3].types) == (1, 0, 0, "Unknown")
    assert (pages[1].duplicate_types, pages[1].website_without_search, pages[1].eligible) == ("Product", True, "Product")
    assert (pages[2].duplicate_types, pages[2].website_without_search, pages[2].types) == ("", False, "BreadcrumbList,Product")
    recs = {(r.id, r.priority, r.type, r.message) for r in J.recommendations(J.validate(df, "id"), "id").collect()}
    assert {(1, "medium", "Product", "duplicate without @id"), (1, "low", "WebSite", "add a search action"), (1, "low", "Product", "hint image size"), (3, "high", "Unknown", "form of json")} <= recs
    assert J.validate(df.limit(0), "id").count() == 0


def test_p75(spark):
    inf = float("inf")
    rows = [("a", 0.0, 2500.0, 0.7), ("a", 2500.0, 4000.0, 0.2), ("a", 4000.0, 8000.0, 0.1), ("b", 0.0, 1000.0, 1.0), ("c", 0.0, 2500.0, 0.5), ("c", 2500.0, inf, 0.5)]
    got = {r.k: r.p75 for r in M.p75(spark.createDataFrame(rows, "k string, lo double, hi double, s double"), "k", "lo", "hi", "s").collect()}
    assert got == {"a": 3250.0, "b": 500.0, "c": 3750.0}


def test_redirects_and_headers(spark):
    runs = spark.createDataFrame([(1, ["http://e.com/a", "https://e.com/a", "https://www.e.com/a", "https://www.e.com/a/"], {"Cache-Control": "max-age=60"}), (2, [], None), (3, None, {})], "run_id bigint, redirect_chain array<string>, headers map<string,string>")
    assert [r.labels for r in G.redirect_hops(runs).orderBy("hop").collect()] == ["https", "www", "slash"]
    assert R.caching(runs).filter("short_ttl").count() == 1
    assert R.security_headers(runs).count() == 2


def test_reader_skips_malformed_lines(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"url":"https://e/","status":200,"links":[{"target":"https://e/a","follow":true,"type":"internal"}]}\n\n{bad\n')
    rows = readers.crawl_jsonl(spark, str(p)).collect()
    assert len(rows) == 1 and rows[0].links[0].link_type == "internal"
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://e/ </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://e/b</loc><lastmod>x</lastmod></url></urlset>")
    assert [(r["loc"], r["lastmod"] is None) for r in readers.sitemap(spark, str(tmp_path / "s.xml")).orderBy("loc").collect()] == [("https://e/", False), ("https://e/b", True)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("e", "1", 'a"b')], "host string, run_ts string, t string")
    writers.run_folder(df, str(tmp_path / "runs"))
    assert readers.latest_run(spark, str(tmp_path / "runs"), "e").first()["t"] == 'a"b'
    assert writers.key_value(df).count() == 3
    assert json.loads(writers.envelope(df, "s", {"q": "1"}).first()[0])["request"] == {"q": "1"}


def test_streaming_equals_batch(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id*7) as ts, concat('k', id % 2) as k from range(50)")
    df.write.parquet(str(tmp_path / "in"))
    q = S.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "k").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda rows: sorted(map(tuple, rows))
    assert key(spark.table("counts").collect()) == key(S.tumbling(df, "ts", "k").collect())


def test_backpressure_and_upsert(spark):
    assert one(spark, F.round(S.backpressure(F.array(*map(F.lit, (429, 429, 200)))), 4), x="") == 2.1375
    df = spark.createDataFrame([("u", False, 1), ("u", True, 2), ("v", False, 3)], "url string, complete boolean, x int")
    assert {(r.url, r.x) for r in S.upsert(df, "url", "complete").collect()} == {("u", 2), ("v", 3)}


def test_third_parties_vendors_and_skeleton(spark):
    html = "<body><script src='https://www.google-analytics.com/a.js'></script><script src='//cdn.e.com/x.js'></script><script src='https://x.other.net/y'></script><svg><g></g></svg><h2 id=a>A</h2><h2 id=b>a</h2><h3 id=c>C</h3><a href='#a'>1</a><a href='#b'>2</a><a href='#c'>3</a><img alt='image1' src=a.webp></body>"
    pages = spark.createDataFrame([(1, "https://www.e.com/p", html)], "p bigint, url string, h string")
    dom = D.dom_nodes(pages, "p", "h").cache()
    assert {(r.domain, r.category) for r in D.third_party(dom, pages, "p").collect()} == {("www.google-analytics.com", "analytics"), ("x.other.net", "other"), ("cdn.e.com", "other")}
    assert D.skeleton_counts(dom, "p").first().n == 8
    assert D.contents_tables(dom, "p").first().n_links == 3
    assert [(r.text, r.n) for r in D.duplicate_headings(dom, "p").collect()] == [("A", 2)]
    assert (D.image_classes(dom, "p").first().alt_class, D.image_classes(dom, "p").first().modern) == ("poor", 1)
    assert D.deepest_path(dom, "p").first().path == "body>svg>g"


def test_property_resolution(spark):
    props = spark.createDataFrame([("domain:e.com",), ("https://e.com/blog/",), ("http://f.org/",), ("https://f.org/a/",)], "property string")
    sites = spark.createDataFrame([("https://shop.e.com/x",), ("https://e.com/blog/1",), ("https://f.org/a/b",), ("https://f.org/c",), ("https://g.net/",)], "url string")
    assert {r.url: r.property for r in M.resolve_property(sites, props).collect()} == {"https://shop.e.com/x": "domain:e.com", "https://e.com/blog/1": "domain:e.com", "https://f.org/a/b": "https://f.org/a/", "https://f.org/c": "http://f.org/"}


def test_markdown_blocks(spark):
    from loomwright.operators import markdown as K

    md = "# T\n\n> a\n> b\n\n> c\n\n- x\ntext\n- y\n\n1. z\n\n```\n# no\n- no\n```\n\n### Deep\n\n| a |\n| --- |\n| b |"
    df = spark.createDataFrame([(1, md, "https://e.com/"), (2, None, None), (3, "", None)], "id bigint, m string, u string")
    r = K.structure(df, "id", "m").collect()
    assert len(r) == 1 and (r[0].headings, r[0].code_blocks, r[0].quote_blocks, r[0].unordered_lists, r[0].ordered_lists, r[0].items, r[0].tables, r[0].table_rows) == (2, 1, 2, 1, 1, 3, 1, 2)
    assert [(x.from_level, x.to_level) for x in K.heading_skips(df, "id", "m").collect()] == [(1, 3)]
    links = spark.createDataFrame([(1, "[read more](/a) ![i](/b) [two words](https://f.org/x) [](https://e.com/y) [https://g.net](https://g.net)", "https://e.com/")], "id bigint, m string, u string")
    assert {(x.anchor_class, x.internal) for x in K.links(links, "id", "m", "u").collect()} == {("generic", True), ("descriptive", False), ("empty", True), ("naked", False)}


def test_release_deletes_what_was_written(spark):
    from loomwright import session

    session.release(spark)
    a, b = session.written(spark.range(3), "t"), session.bucketed(spark.range(3), "b", "id")
    assert a.count() == b.count() == 3 and session.release(spark) == 2 and session.release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(a.inputFiles()[0]).count()


def test_equal_hashes_fall_back_to_numbers(spark, monkeypatch):
    n, e = graph(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    want = {r.url: r.page_rank for r in G.pagerank(n, e, 5).collect()}
    monkeypatch.setattr(G.F, "xxhash64", lambda c: F.lit(1).cast("bigint"))
    assert {r.url: r.page_rank for r in G.pagerank(n, e, 5).collect()} == want
