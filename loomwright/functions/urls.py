"""URL expressions: parts, normalisation, comparison, structure. All are JVM expressions over one column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Query parameters that only track, and endings of files that aren't pages. Fixed values.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "ref", "mc_cid", "mc_eid", "_ga", "_gl")
BINARY = (
    "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "pdf", "css", "js", "mjs", "woff", "woff2", "ttf", "eot", "otf", "mp4", "mp3", "avi", "zip", "gz", "tar", "dmg", "exe", "apk",
)


EDGES = r"^[\s\x{a0}]+|[\s\x{a0}]+$"  # white space at either end, the no-break space too


def trim(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with ?, 5 fragment with #; '' where absent."""
    return F.regexp_extract(trim(url), r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$", n)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d+$", ""))


def path(url: Column) -> Column:
    p = part(url, 3)
    return F.when(p == "", F.lit("/")).otherwise(p)


def strip_tracking(url: Column, params: tuple[str, ...] = TRACKING) -> Column:
    """The address without tracking parameters and without an empty query."""
    keep = F.filter(F.split(F.regexp_replace(part(url, 4), r"^\?", ""), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*params))
    q = F.when(F.size(keep) > 0, F.concat(F.lit("?"), F.array_join(keep, "&"))).otherwise(F.lit(""))
    scheme = part(url, 1)
    return F.concat(F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":"))), F.when(part(url, 2) == "", F.lit("")).otherwise(F.concat(F.lit("//"), part(url, 2))), part(url, 3), q, part(url, 5))


def normalize(url: Column) -> Column:
    """Lower host and scheme, no fragment, no tracking parameters; null for addresses of files that aren't pages."""
    u = strip_tracking(trim(url))
    out = F.concat(F.lower(part(u, 1)), F.lit("://"), F.lower(part(u, 2)), path(u), part(u, 4))
    return F.when(F.lower(part(u, 3)).rlike(r"\.(?:" + "|".join(BINARY) + ")$"), F.lit(None)).otherwise(out)


def comparable(url: Column) -> Column:
    """For comparing: lower scheme and host, no fragment, no slash at the end of a path but the root's; the query stays."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.when(p == "", F.lit("/")).otherwise(p), part(url, 4))


def without_dots(p: Column) -> Column:
    """A path's segments . and .. read: a fold over its segments, so that any number of .. is followed."""
    q = F.regexp_extract(p, r"^([^?#]*)(.*)$", 1)
    rest = F.regexp_extract(p, r"^([^?#]*)(.*)$", 2)
    seg = F.split(q, "/")
    done = F.aggregate(seg, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.array_join(done, "/"), F.when(F.element_at(seg, -1).isin(".", "..") & (F.size(done) > 0), "/").otherwise(""), rest)


def join(base: Column, ref: Column) -> Column:
    """A reference read against its page, for absolute, scheme-relative, root-relative, query, fragment and plain relative references."""
    r = trim(ref)
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_extract(path(base), "^(.*/)", 1)
    joined = F.concat(folder, r)
    clean = without_dots(joined)
    return (
        F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), r)
        .when(r.startswith("//"), F.concat(part(base, 1), F.lit(":"), r))
        .when(r.startswith("/"), F.concat(origin, r))
        .when(r.startswith("?"), F.concat(origin, path(base), r))
        .when(r.startswith("#") | (r == ""), F.concat(origin, path(base), part(base, 4), r))
        .otherwise(F.concat(origin, clean))
    )


def first_segment(url: Column) -> Column:
    """The cluster of a page: its first path segment, 'root' for the root."""
    s = F.regexp_extract(path(url), "^/+([^/]+)", 1)
    return F.when(s == "", F.lit("root")).otherwise(F.lower(s))


def structure(url: Column) -> dict[str, Column]:
    """Columns on how an address is written, and the issues they give."""
    p = path(url)
    seg = F.filter(F.split(p, "/"), lambda x: x != "")
    cols = {
        "url_length": F.length(url).cast("bigint"),
        "n_segments": F.size(seg).cast("bigint"),
        "trailing_slash": (F.length(p) > 1) & p.endswith("/"),
        "has_uppercase": p.rlike("[A-Z]"),
        "has_special": p.rlike("[^a-zA-Z0-9/_.-]"),
        "double_slash": p.contains("//"),
        "keyword_segments": F.size(F.filter(seg, lambda x: x.rlike("^[a-z][a-z-]{2,}$"))).cast("bigint"),
    }
    cols["n_issues"] = sum((c.cast("bigint") for c in (F.length(url) > 75, cols["has_uppercase"], cols["has_special"], cols["double_slash"])), F.lit(0).cast("bigint"))
    return cols


def glob_pattern(pattern: str) -> str:
    """A path glob as a regular expression anchored at the start: * stands for one segment."""
    import re

    return "^" + "[^/]*".join(re.escape(x) for x in pattern.split("*"))


# private and local addresses that a fetch must not follow
def is_private_host(h: Column) -> Column:
    o = F.transform(F.split(h, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    ip = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b = o[0], o[1]
    v4 = ip & ((a == 10) | (a == 127) | (a == 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)))
    return v4 | (h == "localhost") | h.rlike(r"^\[?(::1|f[cd][0-9a-f]{2}:|fe80:)")
