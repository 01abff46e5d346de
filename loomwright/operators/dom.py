"""The relational DOM: each html is parsed once into a table of elements; audits are aggregations over it.

The parser is tolerant and never recurses: void elements close at once, an end tag closes up to the nearest open
element of its name, unmatched end tags are ignored, no end tag is implied, script and style are raw text. A null or
empty html has no elements.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_OF = frozenset("h1 h2 h3 h4 h5 h6 a button title p li label script".split())
DOM = "node_id int, parent_id int, end_id int, depth int, tag string, attrs map<string,string>, text string, n_children int, own_chars int, own_words int, in_head boolean"
SEMANTIC = ("header", "nav", "main", "article", "section", "aside", "footer")
DEPRECATED = ("font", "center", "marquee", "applet", "frameset", "frame", "strike", "u")
HANDLERS = ("onclick", "onload", "onmouseover", "onmouseout", "onchange", "onfocus", "onblur")


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []  # parent, end, depth, tag, attrs, text parts, children, own chars, in head, own words
        self.open: list[int] = []
        self.head = 0

    def handle_starttag(self, tag, attrs):
        i = len(self.nodes)
        parent = self.open[-1] if self.open else -1
        if parent >= 0:
            self.nodes[parent][6] += 1
        self.nodes.append([parent, i, len(self.open), tag, {k: v or "" for k, v in attrs}, [], 0, 0, self.head > 0, 0])
        if tag not in VOID:
            self.open.append(i)
            self.head += tag == "head"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]][3] == tag:
                last = len(self.nodes) - 1
                for i in self.open[k:]:
                    self.nodes[i][1] = last
                    self.head -= self.nodes[i][3] == "head"
                del self.open[k:]
                return

    def handle_data(self, data):
        if not self.open:
            return
        top = self.nodes[self.open[-1]]
        top[7] += len(data.strip())
        top[9] += len(data.split())
        if top[3] in ("script", "style"):
            top[5].append(data)
            return
        for i in self.open:
            if self.nodes[i][3] in TEXT_OF:
                self.nodes[i][5].append(data)


def parse(html: str) -> list[list]:
    t = _Tree()
    t.feed(html)
    t.close()
    last = len(t.nodes) - 1
    for i in t.open:
        t.nodes[i][1] = last
    return t.nodes


def dom_nodes(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, node_id, parent_id, end_id, depth, tag, attrs, text, n_children, own_chars, own_words, in_head); map-only."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                take, rows = [], []
                for i, html in enumerate(batch.column(1).to_pylist()):
                    for n, x in enumerate(parse(html) if html else ()):
                        take.append(i)
                        rows.append((n, x[0], x[1], x[2], x[3], list(x[4].items()), " ".join("".join(x[5]).split()) if x[3] in TEXT_OF else None, x[6], x[7], x[9], x[8]))
                cols = list(zip(*rows)) if rows else [[] for _ in range(11)]
                kinds = [pa.int32()] * 4 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
                names = ["node_id", "parent_id", "end_id", "depth", "tag", "attrs", "text", "n_children", "own_chars", "own_words", "in_head"]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], [id_col, *names])

    return df.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {id_type}, {DOM}")


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def has(name: str) -> Column:
    return F.map_contains_key("attrs", name)


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def repeated(xs: Column) -> Column:
    """The different elements of an array that occur more than once: neighbours in its sorted form."""
    s = F.array_sort(xs)
    return F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False))))


def summary(dom: DataFrame, id_col: str) -> DataFrame:
    """One row for each page with its markup, accessibility, form, script and image counts: one shuffle of partial sums."""
    tag = F.col("tag")
    body = ~tag.isin("meta", "link", "title", "base", "head")
    level = F.when(tag.rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    http = F.lower(attr("href")).rlike("^https?://[^/]")
    rel = F.split(F.lower(F.coalesce(attr("rel"), F.lit(""))), r"\s+")
    return dom.groupBy(id_col).agg(
        _n(body).alias("total_elements"),
        F.count_distinct(F.when(body, tag)).alias("unique_tags"),
        F.max("depth").cast("bigint").alias("depth_max"),
        F.round(F.avg("depth"), 1).alias("depth_avg"),
        F.round(_n(tag == "div") / F.greatest(_n(body), F.lit(1)), 2).alias("div_ratio"),
        F.count_distinct(F.when(tag.isin(*SEMANTIC), tag)).alias("semantic_score"),
        *(_n(tag == f"h{i}").alias(f"h{i}_count") for i in range(1, 7)),
        F.max_by(F.when(level.isNotNull(), F.col("text")), F.when(tag == "h1", -F.col("node_id"))).alias("first_h1"),
        _n((F.col("n_children") == 0) & (F.col("own_chars") == 0)).alias("empty_elements"),
        F.size(repeated(F.collect_list(attr("id")))).cast("bigint").alias("repeated_ids"),
        F.array_join(F.array_sort(F.collect_set(F.when(tag.isin(*DEPRECATED), tag))), ",").alias("deprecated_tags"),
        F.sum(sum((F.coalesce((F.length(attr(h)) > 0).cast("bigint"), F.lit(0)) for h in HANDLERS), F.lit(0))).alias("inline_handlers"),
        _n(tag == "iframe").alias("iframes"),
        F.max(F.coalesce((tag == "meta") & has("charset"), F.lit(False))).alias("has_charset"),
        F.max(F.coalesce((tag == "meta") & (F.lower(attr("name")) == "viewport"), F.lit(False))).alias("has_viewport"),
        F.max(F.coalesce((tag == "html") & (F.length(attr("lang")) > 0), F.lit(False))).alias("has_lang"),
        _n(level.isNotNull() & (F.col("text") == "")).alias("empty_headings"),
        _n((tag == "script") & (F.lower(attr("type")) == "application/ld+json")).alias("jsonld_scripts"),
        _n((tag == "img") & F.lower(attr("src")).rlike(r"\.(webp|avif)(\?|$)")).alias("images_modern"),
        F.max(F.coalesce((tag == "link") & F.array_contains(rel, "icon"), F.lit(False))).alias("has_favicon"),
        _n(tag == "img").alias("images"),
        _n((tag == "img") & ~has("alt")).alias("images_without_alt"),
        _n((tag == "img") & ~(has("width") & has("height"))).alias("images_without_size"),
        _n((tag == "img") & (F.lower(attr("loading")) == "lazy")).alias("images_lazy"),
        _n((tag == "a") & has("href")).alias("links"),
        _n((tag == "a") & http).alias("links_absolute"),
        _n((tag == "a") & (F.col("text") == "") & ~has("aria-label")).alias("links_without_text"),
        _n((tag == "button") & (F.col("text") == "") & ~has("aria-label")).alias("buttons_without_text"),
        _n((tag == "a") & (attr("target") == "_blank") & ~(F.array_contains(rel, "noopener") & F.array_contains(rel, "noreferrer"))).alias("blank_targets_unsafe"),
        _n(tag == "form").alias("forms"),
        _n((tag == "form") & ~has("action")).alias("forms_without_action"),
        _n(tag == "input").alias("inputs"),
        _n(tag == "script").alias("scripts"),
        _n((tag == "script") & has("src")).alias("scripts_external"),
        _n((tag == "script") & has("defer")).alias("scripts_defer"),
        _n((tag == "script") & has("async")).alias("scripts_async"),
        _n(has("style")).alias("inline_styles"),
        _n(F.expr("try_cast(try_element_at(attrs, 'tabindex') AS int) > 0")).alias("positive_tabindex"),
        F.sum(F.size(F.filter(F.map_keys("attrs"), lambda k: k.startswith("aria-")))).alias("aria_attributes"),
    )


def metadata(dom: DataFrame, id_col: str) -> DataFrame:
    """Title, description, robots, canonical, social, language and pagination tags of each page."""
    tag, name, prop = F.col("tag"), F.lower(attr("name")), F.lower(attr("property"))
    rel = F.split(F.lower(F.coalesce(attr("rel"), F.lit(""))), r"\s+")
    first = lambda cond, value: F.min_by(F.when(cond, value), F.when(cond & value.isNotNull(), F.col("node_id")))
    meta = lambda n: first((tag == "meta") & (name == n), attr("content"))
    og = lambda n: F.max_by(F.when((tag == "meta") & (prop == n), attr("content")), F.when((tag == "meta") & (prop == n), F.col("node_id")))
    link = lambda r: first((tag == "link") & F.array_contains(rel, r), attr("href"))
    m = dom.groupBy(id_col).agg(
        first(tag == "title", F.col("text")).alias("title"), meta("description").alias("description"), meta("robots").alias("robots"), link("canonical").alias("canonical"),
        og("og:title").alias("og_title"), og("og:description").alias("og_description"), og("og:image").alias("og_image"), og("og:type").alias("og_type"), og("article:published_time").alias("published_time"), og("article:modified_time").alias("modified_time"), meta("twitter:card").alias("twitter_card"),
        link("prev").alias("prev"), link("next").alias("next"), link("amphtml").alias("amp"),
        F.count_if((tag == "link") & F.array_contains(rel, "preload")).alias("preload"), F.count_if((tag == "link") & F.array_contains(rel, "prefetch")).alias("prefetch"),
        F.count_if((tag == "link") & F.array_contains(rel, "dns-prefetch")).alias("dns_prefetch"), F.count_if((tag == "link") & F.array_contains(rel, "preconnect")).alias("preconnect"),
        F.array_join(F.array_sort(F.collect_set(F.when((tag == "link") & F.array_contains(rel, "alternate"), attr("hreflang")))), ",").alias("hreflang"),
    )
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    return m.withColumns(
        {
            "title_status": F.when(length("title") == 0, "fail").when(F.length("title").between(30, 60), "pass").otherwise("warn"),
            "description_status": F.when(length("description") == 0, "fail").when(F.length("description").between(120, 160), "pass").otherwise("warn"),
            "index": ~F.coalesce(F.lower("robots").contains("noindex"), F.lit(False)), "follow": ~F.coalesce(F.lower("robots").contains("nofollow"), F.lit(False)),
        }
    )


def headings(dom: DataFrame, id_col: str) -> DataFrame:
    """(id, node_id, level, text, previous_level, skipped, parent_id): the outline; the parent is the nearest earlier heading of a smaller level.

    Windows are over one page's headings: the last heading of each level so far, of which the latest of a smaller level is the parent.
    """
    h = dom.filter(F.col("tag").rlike("^h[1-6]$")).select(id_col, "node_id", F.substring("tag", 2, 1).cast("int").alias("level"), "text")
    w = Window.partitionBy(id_col).orderBy("node_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("node_id")), ignorenulls=True).over(before).alias(f"_{k}") for k in range(1, 6)]
    parent = F.greatest(F.lit(None).cast("int"), *(F.when(F.col("level") > k, F.col(f"_{k}")) for k in range(1, 6)))
    return h.select("*", F.lag("level").over(w).alias("previous_level"), *last).select(
        id_col, "node_id", "level", "text", "previous_level", F.coalesce(F.col("level") > F.col("previous_level") + 1, F.lit(False)).alias("skipped"), parent.alias("parent_id"),
    )


def region_words(dom: DataFrame, id_col: str) -> DataFrame:
    """(id, region, n_words) in main, aside, footer and header, first of each: the own words of all elements inside, scripts and styles left out.

    A page has four regions at most, so they are an array beside its elements, and the intervals are compared without a join.
    """
    t = F.col("tag")
    names = ("main", "aside", "footer", "header")
    page = dom.groupBy(id_col).agg(*(F.min(F.when(t == r, F.struct("node_id", "end_id"))).alias(r) for r in names), F.collect_list(F.when((F.col("own_words") > 0) & ~t.isin("script", "style"), F.struct("node_id", "own_words"))).alias("_w"))
    inside = lambda r: F.aggregate(F.filter("_w", lambda x: (x["node_id"] >= F.col(f"{r}.node_id")) & (x["node_id"] <= F.col(f"{r}.end_id"))), F.lit(0), lambda a, x: a + x["own_words"])
    rows = F.array(*(F.when(F.col(r).isNotNull(), F.struct(F.lit(r).alias("region"), inside(r).cast("bigint").alias("n_words"))) for r in names))
    return page.select(id_col, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select(id_col, "x.*")


def unlabelled_inputs(dom: DataFrame, id_col: str) -> DataFrame:
    """(id, node_id) of inputs that aren't hidden, have no label for their id and none around them: two anti joins within the page."""
    labels = dom.filter("tag = 'label'")
    inputs = dom.filter((F.col("tag") == "input") & ~F.lower(F.coalesce(attr("type"), F.lit(""))).isin("hidden")).select(id_col, "node_id", attr("id").alias("iid"))
    named = labels.select(F.col(id_col).alias("p"), attr("for").alias("f"))
    around = labels.select(F.col(id_col).alias("p"), F.col("node_id").alias("a"), F.col("end_id").alias("z"))
    left = inputs.join(named, (inputs[id_col] == named["p"]) & (inputs["iid"] == named["f"]), "left_anti")
    return left.join(around, (left[id_col] == around["p"]) & (left["node_id"] > around["a"]) & (left["node_id"] <= around["z"]), "left_anti").select(id_col, "node_id")


def tag_counts(dom: DataFrame, id_col: str) -> DataFrame:
    return dom.filter(~F.col("tag").isin("meta", "link", "title", "base", "head")).groupBy(id_col, "tag").agg(F.count("*").alias("n"))


def jsonld_blocks(dom: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, item, parse_error): JSON-LD of each page; lists and @graph are opened one level."""
    s = dom.filter((F.col("tag") == "script") & (F.lower(attr("type")) == "application/ld+json")).select(id_col, F.col("node_id").alias("pos"), F.col("text").alias("raw"))
    items = F.expr("coalesce(from_json(raw, 'array<string>'), from_json(get_json_object(raw, '$.@graph'), 'array<string>'), array(raw))")
    return s.withColumn("parse_error", F.try_parse_json("raw").isNull()).select(id_col, "pos", "parse_error", F.explode(items).alias("item"))


# Vendors by their hosts, the first category that has the host counts; and the hosts of tag managers. Fixed values.
VENDORS = {
    "analytics": (
        "www.google-analytics.com", "google-analytics.com", "www.googletagmanager.com", "googletagmanager.com", "analytics.google.com", "snap.licdn.com",
        "static.hotjar.com", "js.hs-analytics.net", "cdn.segment.com", "plausible.io", "cdn.mxpnl.com", "js.hs-scripts.com",
    ),
    "ads": (
        "pagead2.googlesyndication.com", "adservice.google.com", "securepubads.g.doubleclick.net", "ads.twitter.com", "www.googleadservices.com",
        "connect.facebook.net", "static.ads-twitter.com", "platform.twitter.com",
    ),
    "cdn": (
        "cdn.jsdelivr.net", "cdnjs.cloudflare.com", "unpkg.com", "ajax.googleapis.com", "cdn.shopify.com", "assets.squarespace.com",
        "stackpath.bootstrapcdn.com", "code.jquery.com",
    ),
    "social": ("platform.twitter.com", "connect.facebook.net", "platform.linkedin.com", "widgets.pinterest.com", "platform.instagram.com", "apis.google.com"),
}
TAG_MANAGERS = ("www.googletagmanager.com", "googletagmanager.com", "tags.tiqcdn.com", "assets.adobedtm.com", "cdn.cookielaw.org")
DROPPED = ("script", "style", "noscript", "svg")


def third_party(dom: DataFrame, pages: DataFrame, id_col: str, url_col: str = "url") -> DataFrame:
    """(id, domain, category, n, first_seen, tag_manager) of scripts from other hosts; a sub-domain of the page's host is first party.

    A page without an address has no host of its own. first_seen is the element's number, by which the page's order is kept.
    """
    s = dom.filter((F.col("tag") == "script") & F.lower(attr("src")).rlike("^([a-z][a-z0-9+.-]*:)?//")).select(id_col, "node_id", F.regexp_extract(F.lower(attr("src")), "^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]+)", 1).alias("domain"))
    own = pages.select(id_col, F.regexp_extract(F.lower(F.col(url_col)), r"//([^/?#]+)", 1).alias("_own"))
    first = (F.col("_own") != "") & ((F.col("domain") == F.col("_own")) | F.col("domain").endswith(F.concat(F.lit("."), F.col("_own"))))
    s = s.filter("domain <> ''").join(own, id_col).filter(~F.coalesce(first, F.lit(False)))
    cat = F.lit("other")
    for name, hosts in reversed(VENDORS.items()):
        cat = F.when(F.col("domain").isin(*hosts), F.lit(name)).otherwise(cat)
    return s.groupBy(id_col, "domain", cat.alias("category")).agg(F.count("*").alias("n"), F.min("node_id").alias("first_seen"), F.max(F.col("domain").isin(*TAG_MANAGERS)).alias("tag_manager"))


def skeleton_counts(dom: DataFrame, id_col: str) -> DataFrame:
    """(id, n) elements outside the subtrees of scripts, styles, noscript and svg, in one aggregation.

    The subtrees are intervals of element numbers; their union's length, a fold over a page's few intervals, is taken off.
    """
    drop = F.array_sort(F.collect_list(F.when(F.col("tag").isin(*DROPPED), F.struct("node_id", "end_id"))))
    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        first = F.greatest(x["node_id"], a["end"] + 1)
        return F.struct(F.greatest(a["end"], x["end_id"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end_id"] - first + 1)).alias("n"))

    page = dom.groupBy(id_col).agg(F.count("*").alias("all"), drop.alias("d"))
    return page.select(id_col, (F.col("all") - F.aggregate("d", zero, step, lambda a: a["n"])).alias("n")).filter("n > 0")


def image_classes(dom: DataFrame, id_col: str) -> DataFrame:
    """(id, alt_class, n, lazy, modern, sized) of images: missing, empty, short, long, poor or good alternative texts."""
    alt, src = attr("alt"), F.lower(F.coalesce(attr("src"), F.lit("")))
    cls = (
        F.when(~has("alt"), "missing").when(F.trim(alt) == "", "empty").when(F.length(alt) < 3, "short").when(F.length(alt) > 125, "long")
        .when(F.lower(alt).rlike(r"^(image|img|photo|picture|icon|logo)\d*$|\.(jpe?g|png|gif|webp|svg)$"), "poor").otherwise("good")
    )
    return dom.filter("tag = 'img'").groupBy(id_col, cls.alias("alt_class")).agg(F.count("*").alias("n"), F.count_if(F.lower(attr("loading")) == "lazy").alias("lazy"), F.count_if(src.rlike(r"\.(webp|avif)(\?|$)")).alias("modern"), F.count_if(has("width") & has("height")).alias("sized"))


def contents_tables(dom: DataFrame, id_col: str, least: int = 3) -> DataFrame:
    """(id, n_links) of pages with `least` links or more to the ids of their second and third level headings."""
    h = dom.filter("tag in ('h2','h3')").select(id_col, attr("id").alias("hid")).filter("hid is not null").distinct()
    a = dom.filter((F.col("tag") == "a") & attr("href").startswith("#")).select(id_col, F.regexp_replace(attr("href"), "^#", "").alias("hid"))
    return a.join(h, [id_col, "hid"]).groupBy(id_col).agg(F.count("*").alias("n_links")).filter(F.col("n_links") >= least)


def duplicate_headings(dom: DataFrame, id_col: str, most: int = 5) -> DataFrame:
    """(id, text, n): headings that occur twice in a page without regard to case, the most frequent ones."""
    h = dom.filter(F.col("tag").rlike("^h[1-6]$") & (F.col("text") != "")).groupBy(id_col, F.lower("text").alias("_k")).agg(F.count("*").alias("n"), F.min_by("text", "node_id").alias("text"), F.min("node_id").alias("_f")).filter("n > 1")
    w = Window.partitionBy(id_col).orderBy(F.desc("n"), "_f")
    return h.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).select(id_col, "text", "n")


def deepest_path(dom: DataFrame, id_col: str) -> DataFrame:
    """(id, depth, path) of each page's first deepest element: its ancestors by interval join, in order."""
    top = dom.groupBy(id_col).agg(F.min_by("node_id", F.struct(-F.col("depth"), F.col("node_id"))).alias("_n"), F.max("depth").alias("depth"))
    up = dom.select(id_col, "node_id", "end_id", "tag").join(top, id_col).filter("node_id <= _n and _n <= end_id").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("node_id", "tag"))).alias("_p"))
    return up.join(top, id_col).select(id_col, "depth", F.array_join(F.transform("_p", lambda x: x["tag"]), ">").alias("path"))


def largest_image(dom: DataFrame, id_col: str) -> DataFrame:
    """(id, src, area): the first image of the largest declared width times height inside the first main, else anywhere."""
    size = F.expr("try_cast(try_element_at(attrs, 'width') AS int) * try_cast(try_element_at(attrs, 'height') AS int)")
    main = F.min(F.when(F.col("tag") == "main", F.struct("node_id", "end_id")))
    images = F.collect_list(F.when((F.col("tag") == "img") & (size > 0), F.struct(size.alias("area"), (-F.col("node_id")).alias("k"), attr("src").alias("src"))))
    page = dom.groupBy(id_col).agg(main.alias("m"), images.alias("i"))
    inside = F.filter("i", lambda x: F.col("m").isNull() | ((-x["k"] >= F.col("m.node_id")) & (-x["k"] <= F.col("m.end_id"))))
    return page.select(id_col, F.array_max(inside).alias("x")).filter("x is not null").select(id_col, "x.src", F.col("x.area").cast("bigint").alias("area"))


def frame_hosts(dom: DataFrame, id_col: str) -> DataFrame:
    """(id, n_frames, hosts): frames of a page and their different hosts, sorted."""
    host = F.nullif(F.regexp_extract(attr("src"), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", 1), F.lit(""))
    return dom.filter("tag = 'iframe'").groupBy(id_col).agg(F.count("*").alias("n_frames"), F.array_join(F.array_sort(F.collect_set(host)), ",").alias("hosts"))


def in_form_audit(dom: DataFrame, id_col: str) -> DataFrame:
    """(id, n_unlabelled, n_skips): inputs without a label and skips of heading levels, each a count for the page."""
    a = unlabelled_inputs(dom, id_col).groupBy(id_col).agg(F.count("*").alias("n_unlabelled"))
    b = headings(dom, id_col).groupBy(id_col).agg(F.count_if("skipped").alias("n_skips"))
    return a.join(b, id_col, "full").na.fill(0)
