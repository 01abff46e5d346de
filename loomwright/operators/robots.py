"""robots.txt as rule tables, and which path an agent may fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Agents of the verdict matrix and the AI agents among the known ones. Fixed values.
AGENTS = ("*", "googlebot", "bingbot", "gptbot", "ccbot", "anthropic-ai", "google-extended", "perplexitybot", "bytespider")
AI_AGENTS = ("gptbot", "ccbot", "anthropic-ai", "google-extended", "perplexitybot", "bytespider")
TYPOS = {"user-agents": "user-agent", "disallows": "disallow", "allows": "allow", "crawl-delays": "crawl-delay", "sitemaps": "sitemap"}
KNOWN = ("user-agent", "disallow", "allow", "crawl-delay", "sitemap", "host", "clean-param", "noindex", "request-rate", "visit-time")


def parse(txt: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, agent, kind, value, warning): each directive under each agent of its group.

    A group is a run of user-agent lines with the rules behind it; a blank line doesn't close it. Windows are over
    the lines of one file. Null and empty files give none.
    """
    lines = txt.filter(F.length(text_col) > 0).select(id_col, F.posexplode(F.split(F.regexp_replace(text_col, "^﻿", ""), r"\r\n|\n|\r")).alias("line_no", "raw"))
    lines = lines.withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", ""))).filter("raw <> ''")
    key = F.lower(F.trim(F.regexp_extract("raw", "^([^:]*):", 1)))
    fixed = key
    for a, b in TYPOS.items():
        fixed = F.when(key == a, F.lit(b)).otherwise(fixed)
    d = lines.select(id_col, "line_no", fixed.alias("kind"), F.trim(F.regexp_extract("raw", "^[^:]*:(.*)$", 1)).alias("value"), key.alias("_key"))
    w = Window.partitionBy(id_col).orderBy("line_no")
    opens = (F.col("kind") == "user-agent") & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "user-agent")
    d = d.withColumn("grp", F.sum(opens.cast("int")).over(w))
    agents = d.filter("kind = 'user-agent'").groupBy(id_col, "grp").agg(F.collect_set(F.lower("value")).alias("agents"))
    warning = F.when(F.col("_key") != F.col("kind"), "misspelt").when(~F.col("kind").isin(*KNOWN), "unknown").when((F.col("kind") == "crawl-delay") & F.expr("try_cast(value AS double) IS NULL"), "not a number")
    rules = d.filter("kind <> 'user-agent'").withColumn("warning", warning).join(agents, [id_col, "grp"], "left")
    alone = F.col("kind").isin("sitemap", "host")
    return rules.select(id_col, "line_no", F.explode(F.when(alone | F.col("agents").isNull(), F.array(F.lit("*"))).otherwise(F.col("agents"))).alias("agent"), "kind", "value", "warning")


def rule_regex(pattern: Column) -> Column:
    """* as any run of signs, $ at the end as the end, everything else literally, anchored at the start."""
    open_end = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(open_end, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*+", ".*"), F.when(pattern.endswith("$"), F.lit("$")).otherwise(F.lit("")))


def specificity(pattern: Column) -> Column:
    return F.length(F.regexp_replace(pattern, r"\$$", ""))


def verdicts(paths: DataFrame, rules: DataFrame, agents: tuple[str, ...] = AGENTS, key: str = "host") -> DataFrame:
    """(host, path, agent, allowed): the longest matching rule decides, ties allow; an agent without rules uses those of *.

    paths: (host, path); rules: (host, agent, kind, value). Rules meet only paths of their own host (equi join), and
    the matching rules are folded into two lengths before anything is collected.
    """
    own = rules.filter("kind in ('allow','disallow') and value <> ''").select(key, "agent", "kind", F.col("value").alias("pattern"))
    has = rules.filter("kind in ('allow','disallow')").select(key, "agent").distinct()
    a = paths.select(key, "path").distinct().withColumn("agent", F.explode(F.array(*map(F.lit, agents))))
    a = a.join(has.withColumn("_own", F.lit(True)), [key, "agent"], "left").withColumn("_use", F.when(F.col("_own"), F.col("agent")).otherwise(F.lit("*")))
    j = a.join(own.withColumnRenamed("agent", "_use"), [key, "_use"], "left")
    hit = F.when(F.expr("path rlike pattern_re"), specificity(F.col("pattern")))
    j = j.withColumn("pattern_re", rule_regex(F.col("pattern"))).withColumn("_len", hit)
    best = j.groupBy(key, "path", "agent").agg(F.coalesce(F.max(F.when(F.col("kind") == "disallow", F.col("_len"))), F.lit(-1)).alias("d"), F.coalesce(F.max(F.when(F.col("kind") == "allow", F.col("_len"))), F.lit(-1)).alias("a"))
    return best.select(key, "path", "agent", (F.col("d") <= F.col("a")).alias("allowed"))


def ai_summary(rules: DataFrame, key: str) -> DataFrame:
    """(key, n_ai_agents): AI agents with any rule of their own."""
    return rules.filter(F.col("agent").isin(*AI_AGENTS)).groupBy(key).agg(F.count_distinct("agent").alias("n_ai_agents"))


def fetch_policy(status: Column) -> Column:
    return F.when(status == 0, "unreachable").when(status >= 500, "disallow all").when(status >= 400, "allow all").otherwise("parse")


SIZE_LIMIT = 512_000  # bytes of a file that are read at most by the large crawlers


def sitemap_files(files: DataFrame) -> DataFrame:
    """(url, is_index, n_urls, n_children, last_modified) of sitemap texts (url, content); null texts give zeros."""
    t = F.coalesce("content", F.lit(""))
    n = lambda tag: F.regexp_count(t, F.lit(rf"<{tag}(?:\s[^>]*)?>")).cast("bigint")
    dates = F.transform(F.regexp_extract_all(t, F.lit(r"<lastmod>\s*(.*?)\s*</lastmod>"), F.lit(1)), lambda x: F.try_to_timestamp(x))
    return files.select("url", t.rlike(r"<sitemapindex[\s>]").alias("is_index"), n("url").alias("n_urls"), n("sitemap").alias("n_children"), F.array_max(dates).alias("last_modified"))


def expanded(files: DataFrame, children: int = 3) -> DataFrame:
    """(url, child): the first children of each index, `children` of them, which is how far an index is followed."""
    loc = F.regexp_extract_all("content", F.lit(r"(?s)<sitemap>.*?<loc>\s*(.*?)\s*</loc>.*?</sitemap>"), F.lit(1))
    return files.select("url", F.explode(F.slice(loc, 1, children)).alias("child"))


def issues(files: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """(id, code) of each file: unreachable, missing, server error, not text, too large, no agent, blocks all, no sitemap, misspelt or unknown directives.

    files: (id, status, content, content_type). rules: as `parse` gives them.
    """
    blocks = rules.filter((F.col("agent") == "*") & (F.col("kind") == "disallow") & (F.col("value") == "/")).select(id_col).distinct().withColumn("_all", F.lit(True))
    opens = rules.filter((F.col("agent") == "*") & (F.col("kind") == "allow")).select(id_col).distinct().withColumn("_open", F.lit(True))
    maps = rules.filter("kind = 'sitemap'").select(id_col).distinct().withColumn("_map", F.lit(True))
    warned = rules.filter("warning is not null").select(id_col).distinct().withColumn("_warned", F.lit(True))
    d = files
    for x in (blocks, opens, maps, warned):
        d = d.join(x, id_col, "left")
    parsed, size = F.col("status").between(200, 299), F.octet_length("content")
    codes = {
        "unreachable": F.col("status") == 0, "missing": F.col("status").between(400, 499), "server_error": F.col("status") >= 500, "not_text": parsed & ~F.coalesce(F.lower("content_type"), F.lit("text/plain")).startswith("text/plain"),
        "too_large": parsed & (size > SIZE_LIMIT), "empty": parsed & (F.trim(F.coalesce("content", F.lit(""))) == ""), "blocks_all": F.col("_all").isNotNull() & F.col("_open").isNull(), "no_sitemap": parsed & F.col("_map").isNull(), "syntax": F.col("_warned").isNotNull(),
    }
    return d.select(id_col, F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in codes.items())), lambda x: x.isNotNull())).alias("code"))


def simple_verdicts(paths: DataFrame, rules: DataFrame, key: str = "host") -> DataFrame:
    """(host, path, allowed) by prefixes alone, as a plain crawler reads a file: the longest matching rule of * decides, ties allow."""
    own = rules.filter("kind in ('allow','disallow') and value <> '' and agent = '*'").select(key, "kind", "value")
    j = paths.select(key, "path").distinct().join(own, key, "left").withColumn("_n", F.when(F.col("path").startswith(F.col("value")), F.length("value")))
    best = j.groupBy(key, "path").agg(F.coalesce(F.max(F.when(F.col("kind") == "disallow", F.col("_n"))), F.lit(-1)).alias("d"), F.coalesce(F.max(F.when(F.col("kind") == "allow", F.col("_n"))), F.lit(-1)).alias("a"))
    return best.select(key, "path", (F.col("d") <= F.col("a")).alias("allowed"))


def blocked_pages(node_df: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """(url) of the nodes that their host's file forbids to an agent."""
    from ..functions import urls as U

    p = node_df.select("url", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))
    v = verdicts(p, rules, (agent,)).filter(~F.col("allowed"))
    return p.join(v.select("host", "path"), ["host", "path"], "left_semi").select("url")
