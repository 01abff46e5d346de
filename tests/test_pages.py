"""Skeleton and markdown of html, lab figures, robots issues, graph queries, crawl state and search reports."""

import json

import pytest
from pyspark.sql import functions as F

from loomwright.operators import content as C, dom as D, graph as G, lab as L, metrics as M, pagetext as T, report as R, robots as B
from loomwright.sources import landing as A, readers, writers
from loomwright.streaming import flows as S


def test_markdown_of_a_page():
    html = """<html><head><title>x</title><base href="/b/"></head><body><nav>menu</nav><a href="#m">Skip to main content</a><h1>T <em>e</em></h1><p>a <b>b</b> <a href="c?d">link
    text</a><br>next</p><ul><li>one<ul><li>two</li></ul></li><li>three</li></ul><ol><li>x</li><li>y</li></ol><blockquote><p>q</p></blockquote><hr><pre>  code
  more</pre><table><tr><th>h</th><th>i</th></tr><tr><td>a|b</td><td>c<br>d</td></tr></table><img alt="p" src="s.png" srcset="l.png 2x, m.png 1.5x"><div class="cookie x">we use</div><script>no()</script></body></html>"""
    want = "# T _e_\n\na **b** [link text](https://e.com/b/c?d) next\n\n- one\n  - two\n- three\n\n1. x\n2. y\n\n> q\n\n---\n\n```\n  code\n  more\n```\n\n| h | i |\n| --- | --- |\n| a\\|b | c<br>d |\n\n![p](https://e.com/b/l.png)"
    assert T.markdown(html, "https://e.com/a/p") == want
    assert "menu" in T.markdown(html, "https://e.com/a/p", main_only=False)
    assert T.markdown(html, "https://e.com/", include=["ol", "h1"]) == "1. x\n2. y\n\n# T _e_"
    assert "q" not in T.markdown(html, "https://e.com/", exclude=["blockquote"])
    assert T.markdown(None) is None and T.markdown("") == "" and T.markdown("</p><b>x") == "**x**"


def test_skeleton():
    assert T.skeleton('<div class="a">text<p> </p><script>x</script><!-- c --><br>&amp;</div>') == '<div class="a"><p> </p><br></div>'
    assert T.skeleton(None) is None and T.skeleton("") == ""
    assert len(T.skeleton("<div>" * 50_000)) == 50_000 * 11
    assert T.markdown("<div>" * 50_000 + "x") == "x"


def test_sources():
    assert T.best_source({"src": "a", "srcset": "b 480w, c 800w"}) == "c"
    assert T.best_source({"src": "a", "srcset": "b 0.5x"}) == "a" and T.best_source({}) == ""
    assert T.absolute("mailto:x", "https://e") == "mailto:x" and T.absolute("../x", "https://e.com/a/b/c") == "https://e.com/a/x"


def test_split_pages(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "https://e/", "m"), (2, None, None, None), (3, "", "", "")], "id bigint, html string, url string, markdown string")
    assert [tuple(r) for r in T.split_pages(df, "id", "html", "url").orderBy("id").collect()] == [(1, "<p></p>", "a"), (2, None, None), (3, "", "")]
    assert T.split_pages(df.limit(0), "id", "html", "url").count() == 0


ANSWER = {
    "loadingExperience": {"metrics": {"LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 4100, "distributions": [{"min": 0, "max": 2500, "proportion": 0.9}, {"min": 2500, "proportion": 0.1}]}, "CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 5}}},
    "lighthouseResult": {
        "categories": {"performance": {"score": 0.875}, "seo": {"score": 1}},
        "audits": {"interactive": {"numericValue": 12345.6}, "cumulative-layout-shift": {"numericValue": 0.12345}, "unused-css": {"numericValue": 1500.4, "details": {"type": "opportunity", "overallSavingsBytes": 99.6}},
                   "offscreen-images": {"numericValue": 50, "details": {"type": "opportunity"}}, "modern-image-formats": {"numericValue": 5, "details": {"type": "table"}}, "bootup-time": {"details": {"items": [{"url": i} for i in range(9)]}},
                   "resource-summary": {"details": {"items": [{"resourceType": "script", "transferSize": 10, "requestCount": 2}, {"resourceType": "media", "transferSize": 5}]}}},
    },
}


def test_lab_figures(spark):
    rows = [(1, json.dumps(ANSWER)), (2, None), (3, "{bad"), (4, "{}"), (5, json.dumps({"lighthouseResult": {"audits": {"total-byte-weight": {"numericValue": 77.6}}}}))]
    df = spark.createDataFrame(rows, "id bigint, a string")
    assert {(r.id, r.metric): (r.value, r.status) for r in L.field_metrics(df, "id", "a").collect()} == {(1, "lcp"): (4100.0, "fail"), (1, "cls"): (0.05, "good"), (1, "inp"): (0.0, "fail"), (1, "fcp"): (0.0, "warn"), (1, "fid"): (0.0, "fail")}
    assert [(r.metric, r["min"], r["max"]) for r in L.field_buckets(df, "id", "a").collect()] == [("lcp", 0.0, 2500.0), ("lcp", 2500.0, float("inf"))]
    lab = {r.id: r for r in df.select("id", *(c.alias(k) for k, c in (L.lab_columns(F.col("a")) | L.resources(F.col("a"))).items())).collect()}
    assert (lab[1].performance_score, lab[1].tti_s, lab[1].lab_cls, lab[1].seo_category, lab[4].tti_s) == (88, 12.35, 0.123, 100, 0.0)
    assert (lab[1].total_bytes, lab[1].script_requests, lab[1].other_bytes, lab[5].total_bytes, lab[5].script_bytes, lab[2].total_bytes) == (15, 2, 5, 78, 0, None)
    assert {(r.audit, r.savings_ms, r.savings_bytes, r.status) for r in L.opportunities(df, "id", "a").collect()} == {("unused-css", 1500, 100, "fail"), ("offscreen-images", 50, None, "pass")}
    assert L.audit_items(df, "id", "a", "bootup-time").count() == 5
    two = spark.createDataFrame([(1, "desktop", 1, "x"), (1, "mobile", 2, "y"), (1, "mobile", 3, "z"), (2, "desktop", 4, "w")], "id bigint, strategy string, n bigint, a string")
    assert {(r.id, r.a) for r in L.preferred(two, "id", "strategy", "n").collect()} == {(1, "y"), (2, "w")}
    v, s = L.by_priority(F.lit(None).cast("double"), F.lit(2.0), F.lit(3.0))
    assert tuple(spark.range(1).select(v, s).first()) == (2.0, "field")


def test_all_rules(spark):
    runs = spark.createDataFrame(
        [(1, "http://e/", 500, 700.0, None, None, ["a", "b", "c"], {"x": "y"}, None), (2, "https://e/", 200, 1.0, "c", "gzip", None, None, "<html><head><title>t</title></head><body><h1>a</h1><h3>b</h3><input><p id=q></p><p id=q></p></body></html>")],
        "run_id bigint, url string, status int, ttfb_ms double, cdn string, compression string, redirect_chain array<string>, headers map<string,string>, html string",
    )
    dom = D.dom_nodes(runs, "run_id", "html")
    analysis = spark.createDataFrame([(1, 20, "high")], "run_id bigint, word_count bigint, thin_content_risk string")
    figures = spark.createDataFrame([(1, 11.0, 5000.0, True, 40), (2, 1.0, None, False, 40)], "run_id bigint, tti_s double, field_lcp double, has_field boolean, performance_score bigint")
    page = R.merged(runs, D.summary(dom, "run_id"), D.metadata(dom, "run_id"), analysis, D.in_form_audit(dom, "run_id"), D.third_party(dom, runs, "run_id"), figures)
    got = {}
    for r in R.issues(page).collect():
        got.setdefault(r.run_id, set()).add(r.code)
    assert {"http_error", "not_https", "interactive_late", "lcp_poor", "ttfb_slow", "redirect_long", "thin_high", "no_permissions_policy", "no_cache_control", "title_missing"} <= got[1] and "performance_low" not in got[1]
    assert {"performance_low", "inputs_unlabelled", "heading_skip", "duplicate_ids", "no_structured_data", "canonical_missing", "sitemap_missing"} <= got[2] and not {"http_error", "title_missing", "h1_missing", "lcp_poor"} & got[2]
    heads = {r.run_id: r for r in R.front_matter(R.issues(page), page).collect()}
    assert heads[1].n_critical == 5 and heads[1].cdn == "none" and heads[2].cdn == "c"
    assert len({c for c, *_ in R.RULES}) == len(R.RULES) == 42
    search = spark.createDataFrame([("https://e/", 1, 200)], "url string, clicks bigint, impressions bigint")
    seen = spark.createDataFrame([("http://e/", "FAIL", False, "a", "b")], "url string, verdict string, indexed boolean, declared string, chosen string")
    assert {(r.url, r.code) for r in R.search_issues(page, search, seen).collect()} == {("https://e/", "few_clicks"), ("http://e/", "not_indexed"), ("http://e/", "other_canonical")}


def test_dom_figures(spark):
    html = "<body><img src=a width=9 height=9><main><img src=b width=2 height=2><img src=c width=1 height=4><p>hello <a>big world</a></p></main><aside><div>one two three</div><script>x y z</script></aside><iframe src='https://v.example/x'></iframe><iframe></iframe><font>f</font><i id=k></i><i id=k></i><i id=k></i></body>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<img width=3 height=3 src=d>")], "p bigint, h string")
    dom = D.dom_nodes(df, "p", "h")
    assert {(r.p, r.src, r.area) for r in D.largest_image(dom, "p").collect()} == {(1, "b", 4), (3, "d", 9)}
    assert [tuple(r) for r in D.frame_hosts(dom, "p").collect()] == [(1, 2, "v.example")]
    assert {(r.region, r.n_words) for r in D.region_words(dom, "p").collect()} == {("main", 3), ("aside", 3)}
    s = {r.p: r for r in D.summary(dom, "p").collect()}[1]
    assert (s.repeated_ids, s.deprecated_tags, s.empty_elements) == (1, "font", 8)  # three images, two frames, three without text


def test_robots_issues(spark):
    files = [(1, 200, "User-agent: *\nDisallow: /\n", "text/plain"), (2, 404, None, None), (3, 503, "", None), (4, 200, "User-agent: *\nAllows: /\nSitemap: https://e/s.xml\n" + "#" * 600_000, "text/html"), (5, 0, None, None), (6, 200, " ", None)]
    df = spark.createDataFrame(files, "id bigint, status int, content string, content_type string")
    got = {}
    for r in B.issues(df, B.parse(df, "id", "content"), "id").collect():
        got.setdefault(r.id, set()).add(r.code)
    assert got == {1: {"blocks_all", "no_sitemap"}, 2: {"missing"}, 3: {"server_error"}, 4: {"not_text", "too_large", "syntax"}, 5: {"unreachable"}, 6: {"empty", "no_sitemap"}}
    maps = spark.createDataFrame([("a", "<urlset><url><loc>x</loc><lastmod>2024-02-03</lastmod></url><url><loc>y</loc></url></urlset>"), ("b", "<sitemapindex>" + "".join(f"<sitemap><loc> {i} </loc></sitemap>" for i in range(5)) + "</sitemapindex>"), ("c", None)], "url string, content string")
    assert {(r.url, r.is_index, r.n_urls, r.n_children) for r in B.sitemap_files(maps).collect()} == {("a", False, 2, 0), ("b", True, 0, 5), ("c", False, 0, 0)}
    assert [r.child for r in B.expanded(maps).collect()] == ["0", "1", "2"]
    rules = spark.createDataFrame([("h", "*", "disallow", "/a"), ("h", "*", "allow", "/a/b")], "host string, agent string, kind string, value string")
    paths = spark.createDataFrame([("h", "/a/x"), ("h", "/a/b/c"), ("h", "/z")], "host string, path string")
    assert {r.path: r.allowed for r in B.simple_verdicts(paths, rules).collect()} == {"/a/x": False, "/a/b/c": True, "/z": True}
    nodes = spark.createDataFrame([("https://h/a/x",), ("https://h/q",)], "url string")
    assert [r.url for r in B.blocked_pages(nodes, rules).collect()] == ["https://h/a/x"]


def test_graph_queries(spark):
    e = spark.createDataFrame([("a", "b", True, True), ("a", "b", False, True), ("b", "c", False, True), ("a", "https://x.example/1", True, False)], "src string, dst string, follow boolean, internal boolean")
    n = spark.createDataFrame([(u, i, d) for u, i, d in (("a", 0, 0), ("b", 2, 5), ("c", 1, 1), ("d", 0, 9))], "url string, inlinks bigint, crawl_depth int")
    assert [tuple(r) for r in G.external_nodes(e).collect()] == [("ext:x.example", "external", 1)]
    ids = {r.url: r.id for r in G.dictionary(n).collect()}
    assert ids == {"a": 0, "b": 1, "c": 2, "d": 3} and G.dictionary(n.limit(0)).count() == 0
    urls, links = G.compact(n, e)
    assert {tuple(r) for r in G.expand(urls, links).collect()} == {("a", "b", True), ("b", "c", False), ("a", "https://x.example/1", True)}
    assert {(r.direction, r.url) for r in G.links_of(e, "b").collect()} == {("in", "a"), ("out", "c")}
    assert {r.url for r in G.not_crawled(spark.createDataFrame([("a",), ("z",), (None,)], "url string"), n).collect()} == {"z"}
    o = G.overlay(n, spark.createDataFrame([("b", 1, 10, 2.0), ("b", 1, 30, 4.0), ("d", 0, 5, 1.0)], "url string, clicks bigint, impressions bigint, position double"))
    assert {r.url: r.search_position for r in o.collect()} == {"a": None, "b": 3.5, "c": None, "d": 1.0}
    assert {(r.section, r.url) for r in G.unranked(o).collect()} == {("unranked", "c"), ("unranked", "a"), ("ranked_orphans", "d"), ("ranked_deep", "d"), ("ranked_deep", "b")}
    c = spark.createDataFrame([("x", 0.5), ("y", 0.9), ("z", 0.9)], "url string, priority double")
    assert [r.url for r in G.frontier(c, c.filter("url = 'y'"), 1).collect()] == ["z"]
    chain = spark.createDataFrame([(f"https://e/{i}", f"https://e/{j}", True, True) for i, j in ((0, 1), (0, 2), (1, 3), (3, 4), (4, 5), (2, 0))], "src string, dst string, follow boolean, internal boolean")
    assert {r.url[-1]: r.depth for r in G.crawl_tree(chain, "https://e/0").collect()} == {"0": 0, "1": 1, "2": 1, "3": 2, "4": 3}
    assert G.crawl_tree(chain, "https://e/0", max_pages=2).count() == 2
    assert G.crawl_tree(chain, "https://e/0", exclude="/1").count() == 2


@pytest.mark.parametrize("stretch", [2, 3, 4096])
def test_backpressure_in_stretches_equals_the_plain_fold(spark, stretch):
    import random

    rnd = random.Random(3)
    rows = [("h", i, rnd.choice([200, 429, 429, 500, 404, None])) for i in range(200)] + [("g", 5, 200), ("k", 1, None)]
    got = {r.h: r.factor for r in S.backpressure_by(spark.createDataFrame(rows, "h string, o bigint, s int"), "h", "o", "s", stretch).collect()}
    m = 1.0
    for _, _, s in rows[:200]:
        m = min(m * 1.5, 10.0) if s == 429 else max(1.0, m * 0.95) if s is not None and s < 400 and m > 1 else m
    assert got.keys() == {"h", "g"} and got["h"] == pytest.approx(m) and got["g"] == 1.0


def test_retry_after(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    v = spark.createDataFrame([("30",), ("120",), ("x",), ("Mon, 01 Jan 2024 00:00:10 GMT",), (None,), ("-5",)], "v string")
    assert [r[0] for r in v.select(S.retry_after(F.col("v"), now)).collect()] == [30000, 60000, None, 10000, None, None]
    assert [r[0] for r in spark.range(3).select(S.backoff(F.col("id"))).collect()] == [1000, 2000, 4000]


def test_search_ranges_and_reports(spark):
    assert M.date_range("2026-01-21", "2026-01-01", "2026-01-10") == ("2026-01-01", "2026-01-10")
    assert M.date_range("2026-01-21") == ("2025-12-24", "2026-01-21") and M.date_range("2026-01-21", days=6) == ("2026-01-15", "2026-01-21")
    assert M.previous_range("2026-01-15", "2026-01-21") == ("2026-01-08", "2026-01-14")
    rows = [("2026-01-15", "p", f"q{i}", "usa", "MOBILE", i, 10, 1.0) for i in range(30)] + [("2026-02-15", "p", "q", "usa", "MOBILE", 1, 1, 1.0), ("2026-01-16", "p", "q", "deu", "DESKTOP", 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "date string, page string, query string, country string, device string, clicks bigint, impressions bigint, position double").withColumn("date", F.to_date("date"))
    some = M.filtered(df, "2026-01-15", "2026-01-21", "USA", "mobile")
    assert some.count() == 30 and M.filtered(df, "2026-01-01", "2026-12-31", page="other").count() == 0
    rep = M.page_report(some, "page").collect()
    assert len(rep) == 26 and next(r for r in rep if r["rank"] == 0).clicks == 435 and next(r for r in rep if r["rank"] == 1).query == "q29"


def test_content_fixtures(spark):
    long = "word " * 350
    md = {1: "Short page.", 2: "word " * 150, 3: "One two three four five six seven. " * 50, 4: "a b c d e f. " * 200, 5: long, 6: "\n\n".join(["Hi."] * 10), 7: None, 8: ""}
    df = spark.createDataFrame([(k, "https://e/", v, "Title of pages", None) for k, v in md.items()], "id bigint, url string, m string, t string, d string")
    got = {r.id: r for r in C.analyse(df, "id", "m", "t", "d", "url", 2026).collect()}
    assert [got[i].depth_label for i in (1, 2, 3, 4)] == ["thin", "short", "adequate", "comprehensive"]
    assert "oversized paragraph" in got[5].depth_issues and "fragmented" in got[6].depth_issues and got[7].word_count == got[8].word_count == 0
    page = "# The red kettle\n\nThe red kettle is a pot. According to a study 45% of people use it in 2025.\n\n## Red kettle\n\nWe like our kettle. Buy now!\n\n## What is it?\n\nA pot.\n\n## Why?\n\nWater.\n\n[here](/a) [two words](https://x.example/) ![ ](/i)\n\n| a | b |\n| --- | --- |\n| c | d |\n"
    one = C.analyse(spark.createDataFrame([(1, "https://shop.test/", page, "Red kettle", "d" * 130)], "id bigint, url string, m string, t string, d string"), "id", "m", "t", "d", "url", 2026).first()
    assert one.title_in_h1 and one.title_in_intro and one.title_position == 1 and one.heading_alignment == 0.33
    assert (one.first_person, one.statistics, one.citations, one.recent_year, one.freshness) == (1, 1, 1, 2025, "recent")  # words of the first person in lower case
    assert one.questions == 2 and set(one.snippet_kinds) == {"faq", "table"} and one.calls == ["buy now"]
    assert (one.anchors_generic, one.anchors_empty, one.links_internal, one.links_external, one.images_without_alt, one.description_status) == (1, 1, 2, 1, 1, "optimal")
    assert one.score == 100 - sum(n for c, n in ((one.depth_label == "thin", 15), (one.depth_label == "short", 7), (one.heading_alignment < 0.5, 5), (one.stuffed, 15), (one.thin_risk == "low", 5), (one.thin_risk == "medium", 10), (one.anchor_score == "fair", 5), (one.anchor_score == "poor", 10), (one.reading_level == "difficult", 5), (one.reading_level == "academic", 10)) if c)


def test_sentences_alike_equal_brute_force(spark):
    import random
    import re

    rnd = random.Random(7)
    base = ["the red kettle stands on the small table near a window", "every visitor of the museum looks at the old red kettle", "nothing else is said about it in the whole of this book"]
    sents = []
    for _ in range(40):
        w = rnd.choice(base).split()
        if rnd.random() < 0.6:
            w[rnd.randrange(len(w))] = rnd.choice(["blue", "green", "house"])
        sents.append(" ".join(w))
    sets = [set(re.findall(r"\w+", s)) for s in sents]
    want = sum(len(a & b) / max(len(a), len(b)) > 0.8 for i, a in enumerate(sets) for b in sets[i + 1 :])
    df = spark.createDataFrame([(1, ". ".join(sents)), (2, None), (3, "a. b. c.")], "id bigint, m string")
    assert want and [tuple(r) for r in C.alike_sentences(df, "id", "m").collect()] == [(1, want)]


def test_landed_answers(spark, tmp_path):
    rec = json.dumps({"record": {"metrics": {"largest_contentful_paint": {"percentiles": {"p75": 2600}}, "cumulative_layout_shift": {"percentiles": {"p75": "0.05"}}}}})
    df = spark.createDataFrame([("https://e/a", rec), ("https://e/b", None), ("https://f/c", "{bad")], "url string, answer string")
    assert {(r.url, r.metric, r.value, r.status) for r in A.record_metrics(df, "url", "answer").collect()} == {("https://e/a", "lcp", 2600.0, "warn"), ("https://e/a", "cls", 0.05, "good"), ("https://e/a", "fid", 0.0, "fail"), ("https://e/a", "inp", 0.0, "fail")}
    o = spark.createDataFrame([("https://e", "{}")], "origin string, answer string")
    assert {(r.url, r.scope) for r in A.url_or_origin(df, df, o, "answer").collect()} == {("https://e/a", "url"), ("https://e/b", "origin"), ("https://f/c", "url")}
    pages = [json.dumps({"rows": [{"keys": ["q1", "usa"], "clicks": 1, "impressions": 10, "ctr": 0.1, "position": 2}]}), json.dumps({"rows": []}), "{}", None]
    rows = A.search_rows(spark.createDataFrame([(x,) for x in pages], "answer string"), "answer", ["query", "country"]).collect()
    assert [(r.query, r.country, r.clicks, r.impressions) for r in rows] == [("q1", "usa", 1, 10)]
    seen = json.dumps({"inspectionResult": {"indexStatusResult": {"verdict": "PASS", "userCanonical": "a", "googleCanonical": "b"}, "richResultsResult": {"detectedItems": [{"richResultType": "FAQ"}]}}})
    i = A.inspections(spark.createDataFrame([("u", seen), ("v", "{}"), ("w", '{"inspectionResult":{}}')], "url string, answer string"), "url", "answer")
    assert {(r.url, r.verdict, r.indexed) for r in i.collect()} == {("u", "PASS", True), ("w", "NEUTRAL", False)} and i.first().rich_types == ["FAQ"]
    maps = A.listed_sitemaps(spark.createDataFrame([("u", json.dumps({"sitemap": [{"path": "s", "errors": "2", "contents": [{"submitted": "5", "indexed": "3"}]}, {}]}))], "url string, answer string"), "url", "answer")
    assert {(r.path, r.errors, r.submitted, r.indexed) for r in maps.collect()} == {("s", 2, 5, 3), ("", 0, 0, 0)}
    s = spark.createDataFrame([("u", 1, 5), ("z", 1, 1)], "url string, clicks bigint, impressions bigint")
    assert {(r.url, r.clicks, r.n_sitemaps) for r in A.search_data(spark.createDataFrame([("u",), ("w",), ("x",)], "url string"), s, i, maps).collect()} == {("u", 1, 2), ("w", None, 0)}
    (tmp_path / "r.jsonl").write_text('{"origin":"https://e","status":200,"content":"User-agent: *"}\n\n{bad\n')
    assert [r.status for r in A.robots_files(spark, str(tmp_path / "r.jsonl")).collect()] == [200]
    st = spark.createDataFrame([("https://e/sitemap.xml", 404), ("https://e/sitemap_index.xml", 200)], "url string, status int")
    assert [r.url for r in A.sitemap_candidates(spark.createDataFrame([("https://e",)], "origin string"), st).collect()] == ["https://e/sitemap_index.xml"]
    h = A.request_headers(F.col("h"), {"a": "1", "b": "1"}, {"e": {"b": "2"}}, {"c": "3", "a": "9"})
    assert [r[0] for r in spark.createDataFrame([("e",), ("f",)], "h string").select(h).collect()] == [{"a": "9", "b": "2", "c": "3"}, {"a": "9", "b": "1", "c": "3"}]
    assert A.header_flags(["A: b:c", "bad", ":x"]) == {"A": "b:c"}
    assert [r[0] for r in spark.createDataFrame([("https://e",), ("ftp://e",), ("http://",), (None,)], "u string").select(A.is_web_address(F.col("u"))).collect()] == [True, False, False, False]


def test_runs_and_sitemaps(spark, tmp_path):
    df = spark.createDataFrame([("e_com", "1", "x"), ("e_com", "2", "y"), ("f", "3", "z")], "host string, run_ts string, t string")
    writers.run_folder(df, str(tmp_path / "r"))
    assert readers.find_run(spark, str(tmp_path / "r"), "e.com").first()["t"] == "y" and readers.find_run(spark, str(tmp_path / "r"), "e.com", "1").first()["t"] == "x"
    assert readers.newest_run(spark, str(tmp_path / "r")).first()["t"] == "z"
    files = spark.createDataFrame([("https://e/s", "https://www.e/t", None, True), ("https://www.e/t", "https://e/a", None, False), ("https://www.e/t", "https://other/b", None, False), ("https://e/q", "https://e/z", None, False)], "file string, loc string, lastmod timestamp, is_index boolean")
    assert [r["loc"] for r in readers.followed_sitemaps(files, "https://e/s").collect()] == ["https://e/a"]
    e = spark.createDataFrame([("https://e/0", "https://e/1", True, True), ("https://e/1", "https://e/2", True, True), ("https://e/0", "https://e/3", True, True), ("https://e/3", "https://e/2", True, True)], "src string, dst string, follow boolean, internal boolean")
    assert writers.link_tree(G.crawl_tree(e, "https://e/0"), e, "https://e/0") == "https://e/0\n  https://e/1\n    https://e/2\n  https://e/3"
    writers.jsonld_files(spark.createDataFrame([(1, "{}"), (2, "[]")], "p int, item string"), str(tmp_path / "j"), "p")
    assert spark.read.text(str(tmp_path / "j")).count() == 2


def test_scripts_and_inventories(spark):
    t = spark.createDataFrame([("これは日本語です。",), ("한국어 문장입니다",), ("中文句子在这里",), ("plain words here",), ("",)], "t string")
    lang = C.script_language(F.col("t"), F.lit("en"))
    assert [r[0] for r in t.select(lang).collect()] == ["ja", "ko", "zh", "en", "en"]
    v = C.volume(F.col("t"), lang)
    assert [r[0] for r in t.select(v["n_words"]).collect()] == [8, 8, 7, 3, 0]
    md = "# One\n\n[a](/1) ![b](/2) [c](/3)"
    inv = spark.createDataFrame([(md,)], "m string").select(*(c.alias(k) for k, c in C.inventory(F.col("m"), 1, 1).items())).first()
    assert inv.links == ["/1"] and inv.links_truncated and inv.images == ["/2"] and not inv.images_truncated and inv.first_h1 == "One"
    assert tuple(spark.range(1).select(C.chrome_ratio(F.lit(1), F.lit(3)), C.chrome_ratio(F.lit(1), F.lit(0)), C.per_thousand(F.lit(3), F.lit(2000))).first()) == (0.333, None, 1.5)
