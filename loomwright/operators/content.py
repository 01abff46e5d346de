"""The analysis of a page's text: one row for each markdown with the signals of its depth, relevance, trust, age and style.

Every signal is a JVM expression over one row's text; nothing is exploded, so the analysis is map-only. Signals of a language go
by the language whose stop words the text has most of (en, de, es). The one exception are sentences alike, which
are found by a prefix join within each text (`alike_sentences`).

Defined results: a null text is read as ''; ratios over nothing are those of an empty text (diversity 0, alignment 1); rows
are kept as they are, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import texts as X, urls as U
from .graph import top_per_group

# Patterns of the three languages. Fixed values.
FIRST_PERSON = {
    "en": r"\b(I|we|my|our|I've|we've|I'm|we're|I'll|we'll)\b",
    "de": r"\b(ich|wir|mein|meine|unser|unsere)\b",
    "es": r"\b(yo|nosotros|mi|mío|nuestro|nuestra)\b",
}
CALLS = {
    "en": (
        "buy now", "shop now", "order now", "add to cart", "sign up", "sign up free", "sign up now", "get started", "start now", "start free", "start trial",
        "free trial", "try free", "try it free", "try for free", "contact us", "get in touch", "reach out", "subscribe", "subscribe now", "download", "download now",
        "download free", "request a demo", "book a demo", "schedule a demo", "claim your", "get your free", "get a quote", "register now", "create account",
        "join now", "learn more", "find out more", "discover more",
    ),
    "de": ("jetzt kaufen", "kostenlos testen", "anmelden", "jetzt starten"),
    "es": ("comprar ahora", "regístrate", "empieza gratis", "prueba gratis"),
}
BOILERPLATE = {
    "en": ("lorem ipsum", "coming soon", "under construction", "placeholder text", "sample content", "all rights reserved", "cookie policy", "privacy policy", "terms and conditions"),
    "de": ("lorem ipsum", "demnächst verfügbar", "im aufbau"),
    "es": ("lorem ipsum", "próximamente", "en construcción"),
}
TIMELY = {
    "en": ("currently", "right now", "today", "latest", "newest", "now", "this year"),
    "de": ("aktuell", "jetzt", "heute", "neueste"),
    "es": ("actualmente", "ahora", "hoy", "último"),
}
CITED = {
    "en": ("according to", "study by", "research shows", "source:", "per a study", "researchers found"),
    "de": ("laut", "studie von", "forscher zeigen", "laut forschung"),
    "es": ("según", "estudio de", "investigadores muestran"),
}
AUTHOR_BIO = {
    "en": r"\babout the author\b|\bauthor bio\b|\bauthor profile\b|\bwritten by\b|\bby [A-Z][a-z]+ [A-Z][a-z]+\b|\bcontributed by\b|\bauthored by\b",
    "de": "über den autor|geschrieben von|autor profil",
    "es": "sobre el autor|escrito por|perfil del autor",
}
STATISTICS = r"(?i)\d+(?:\.\d+)?\s*(?:%|percent|\$|ms|kb|mb|gb|px|em|rem|fps|rpm|mph|kg|lb|oz|cm|mm|km|mi|ft|in)(?=[^\p{L}\p{N}_]|$)"
AUTHOR = r"(?<![.!?]\s)(?<!\n)[A-Z][a-z]+\s+[A-Z][a-z]+"
DATES = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b|\b\d{1,2}/\d{1,2}/\d{4}\b"
YEARS = r"\b(199[0-9]|20[0-2][0-9]|2030)\b"
DEFINES = r"(?i)\b[\p{L}\p{N}_]+\s+(?:is|are|refers? to|means?|describes?)\b"
CLAIM = r"(?i)^[^.!?]{0,200}\b(never|always|every|most|best|worst|only|must|will|cannot|impossible|definitely|absolutely|guaranteed)\b"
PASSIVE = r"(?i)\b(?:was|were|is|are|been|being|be)\s+[\p{L}\p{N}_]+ed\b"
GENERIC = (
    "click here", "here", "read more", "learn more", "this", "this page", "this post", "this article", "link", "more", "continue", "visit", "see more", "find out more", "details",
)


def by_language(lang: Column, pick) -> Column:
    """pick(code) for the row's language."""
    return F.when(lang == "de", pick("de")).when(lang == "es", pick("es")).otherwise(pick("en"))


def strings(xs) -> Column:
    return F.array(*map(F.lit, xs))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def found(text: Column, phrases, word: bool) -> Column:
    """The phrases that a text in lower case has, as words or as parts."""
    hit = lambda p: text.rlike(r"\b\Q" + p + r"\E\b") if word else text.contains(p)
    return F.filter(F.array(*(F.when(hit(p), F.lit(p)) for p in phrases)), lambda x: x.isNotNull())


def longest_run(xs: Column) -> Column:
    """How often the most frequent element of an array occurs: the longest run of its sorted form, in one fold."""
    zero = F.struct(F.lit(None).cast("string").alias("p"), F.lit(0).alias("r"), F.lit(0).alias("m"))

    def step(a: Column, x: Column) -> Column:
        r = F.when(a["p"] == x, a["r"] + 1).otherwise(1)
        return F.struct(x.alias("p"), r.alias("r"), F.greatest(a["m"], r).alias("m"))

    return F.aggregate(F.array_sort(xs), zero, step, lambda a: a["m"])


def headings(md: Column) -> Column:
    """(level, text) of each heading line, in order."""
    line = lambda x: U.trim(x)
    hit = F.filter(F.split(md, "\n"), lambda x: line(x).rlike(r"^#{1,6}\s+"))
    return F.transform(hit, lambda x: F.struct(F.length(F.regexp_extract(line(x), "^(#+)", 1)).alias("level"), U.trim(F.regexp_replace(line(x), r"^#{1,6}\s+", "")).alias("text")))


def prepared(df: DataFrame, md_col: str, title_col: str | None) -> DataFrame:
    """The rows with _md, _plain, _low, _lang, _words, _paras, _heads and _title."""
    d = df.withColumn("_md", F.coalesce(F.col(md_col), F.lit(""))).withColumn("_title", F.coalesce(F.col(title_col), F.lit("")) if title_col else F.lit(""))
    d = d.withColumn("_plain", X.strip_markdown(F.col("_md")))
    d = d.withColumns({"_low": F.lower("_plain"), "_lang": X.guess_language(F.col("_plain")), "_words": F.regexp_extract_all("_plain", F.lit(X.WORDS), F.lit(0)), "_heads": headings(F.col("_md"))})
    return d.withColumn("_paras", F.filter(F.transform(F.split("_plain", r"\n\n+"), U.trim), lambda p: p != ""))


def n_words(t: Column) -> Column:
    return F.regexp_count(t, F.lit(X.WORDS))


def without_stops(tokens: Column, lang: Column) -> Column:
    return by_language(lang, lambda k: F.filter(tokens, lambda w: ~w.isin(*X.STOP[k])))


def depth() -> dict[str, Column]:
    """Words, paragraphs, their lengths, label, reading time, diversity and issues."""
    w, lens = F.size("_words"), F.transform("_paras", n_words)
    total = F.aggregate(lens, F.lit(0), lambda a, x: a + x)
    mean = F.when(F.size("_paras") > 0, total / F.size("_paras")).otherwise(F.lit(0.0))
    div = F.when(w > 0, F.bround(F.size(F.array_distinct(F.transform("_words", F.lower))) / w, 3)).otherwise(F.lit(0.0))
    issues = F.concat(
        F.transform(F.filter(lens, lambda n: n > 300), lambda n: F.lit("oversized paragraph")),
        F.filter(F.array(F.when(mean > 150, F.lit("wall of text")), F.when((mean < 10) & (F.size("_paras") > 0), F.lit("fragmented"))), lambda x: x.isNotNull()),
    )
    return {
        "word_count": w.cast("bigint"), "paragraph_count": F.size("_paras").cast("bigint"), "avg_paragraph_length": F.bround(mean, 1), "depth_label": X.depth_label(w), "reading_minutes": F.bround(w / 200.0, 1),
        "diversity": div, "diversity_label": F.when(div < 0.3, "low").when(div <= 0.5, "medium").otherwise("high"), "paragraph_p50": X.nearest_rank(lens, 0.5), "paragraph_p90": X.nearest_rank(lens, 0.9), "depth_issues": issues,
    }


def relevance() -> dict[str, Column]:
    """Where the title's words occur, whether sections speak of their headings, and a word beyond 5 % of all."""
    lang = F.col("_lang")
    terms = F.array_distinct(without_stops(X.tokens(F.col("_title")), lang))
    h1 = F.filter("_heads", lambda h: h["level"] == 1)
    intro = F.slice(X.tokens(F.col("_plain")), 1, 100)
    at = F.filter(F.transform(intro, lambda w, i: F.when(F.array_contains(terms, w), i)), lambda x: x.isNotNull())
    cut = F.split("_md", r"(?m)^[ \t]*##[ \t]+")
    sections = F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))
    some = lambda t: without_stops(X.tokens(t), lang)
    aligned = F.filter(sections, lambda s: F.arrays_overlap(some(F.substring_index(s, "\n", 1)), some(X.strip_markdown(F.regexp_replace(F.regexp_replace(s, r"^[^\n]*\n?", ""), "\n", " ")))))
    words = some(F.col("_plain"))
    return {
        "title_in_h1": F.exists(h1, lambda h: F.arrays_overlap(terms, X.tokens(h["text"]))), "title_position": F.get(at, F.lit(0)), "title_in_intro": F.size(at) > 0,
        "heading_alignment": F.when(F.size(sections) > 0, F.bround(F.size(aligned) / F.size(sections), 2)).otherwise(F.lit(1.0)),
        "stuffed": F.when(F.size(words) > 0, longest_run(words) / F.size(words) > 0.05).otherwise(F.lit(False)),
    }


def trust(this_year: Column) -> dict[str, Column]:
    """Signals of experience and age: first person, numbers, citations, authors, dates, words of time without a date."""
    p, lang = F.col("_plain"), F.col("_lang")
    first = by_language(lang, lambda k: count(p, FIRST_PERSON[k]))
    stats = count(p, STATISTICS)
    cited = by_language(lang, lambda k: sum((count(p, "(?i)" + x) for x in CITED[k]), F.lit(0).cast("bigint")))
    author = p.rlike(AUTHOR)
    years = F.transform(F.regexp_extract_all(p, F.lit(YEARS), F.lit(1)), lambda y: y.cast("int"))
    recent = F.array_max(years)
    dated = recent.isNotNull() | p.rlike(DATES)
    split = F.split(p, r"\s+")
    timely = lambda w: by_language(lang, lambda k: F.regexp_replace(F.lower(w), r"[.,!?]+$", "").isin(*TIMELY[k]))
    hits = F.filter(F.transform(split, lambda w, i: F.when(timely(w), i)), lambda x: x.isNotNull())
    near = F.exists(hits, lambda i: ~F.array_join(F.slice(split, F.greatest(i - 49, F.lit(1)), F.lit(50) + F.least(i, F.lit(50))), " ").rlike(r"\b\d{4}\b"))
    n = sum((x.cast("int") for x in (first > 0, stats > 0, cited > 0, author, dated)), F.lit(0))
    phrases = by_language(lang, lambda k: found(F.col("_low"), TIMELY[k], True))
    age = this_year - recent
    return {
        "first_person": first, "statistics": stats, "citations": cited, "author_named": author, "dated": dated, "timely_without_date_near": near, "trust_signals": n.cast("bigint"),
        "trust_label": F.when(n <= 1, "weak").when(n <= 3, "moderate").otherwise("strong"), "years": F.array_sort(F.array_distinct(years)), "recent_year": recent,
        "freshness": F.when(recent.isNull(), "undated").when(age == 0, "current").when(age == 1, "recent").when(age == 2, "stale").otherwise("very_stale"),
        "timely_phrases": phrases, "timely_without_date": (F.size(phrases) > 0) & recent.isNull(),
    }


def snippets() -> dict[str, Column]:
    """Forms that a search page can show: a definition, a list under a heading, questions with answers, a table."""
    md = F.col("_md")
    opening = F.regexp_extract(F.coalesce(F.get("_paras", F.lit(0)), F.lit("")), r"^(.{0,300}[.!?])", 1)
    lists = F.regexp_extract_all(md, F.lit(r"(?m)^#{1,6}\s+.+\n((?:(?:[-*+]|\d+\.)\s+.+\n?)+)"), F.lit(1))
    items = lambda x: F.regexp_extract_all(x, F.lit(r"(?m)^(?:[-*+]|\d+\.)\s+(.+)"), F.lit(1))
    mean = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x)) / F.size(xs)
    fit = F.exists(lists, lambda x: (F.size(items(x)) >= 3) & mean(items(x)).between(40, 80))
    asked = count(md, r"(?m)^[ \t]*#{1,6}[ \t]+[^\n]+\?[ \t]*\n(?:[ \t]*\n)*(?![ \t]*#{1,6}\s)[ \t]*\S")
    tables = count(md, r"(?m)^\|.+\|\s*\n\|[-:| ]+\|\s*\n(?:\|.+\|\s*\n)+")
    kinds = F.array(F.when(opening.rlike(DEFINES), "paragraph"), F.when(fit, "list"), F.when(asked >= 2, "faq"), F.when(tables > 0, "table"))
    return {"lists_under_headings": F.size(lists).cast("bigint"), "questions": asked, "tables_with_headers": tables, "snippet_kinds": F.filter(kinds, lambda x: x.isNotNull())}


def thin() -> dict[str, Column]:
    """Signals of little effort; sentences alike come from `alike_sentences` as the column n_alike."""
    boiler = by_language(F.col("_lang"), lambda k: found(F.col("_low"), BOILERPLATE[k], False))
    norm = F.filter(F.transform("_paras", lambda p: F.regexp_replace(F.lower(p), r"\s+", " ")), lambda p: F.length(p) >= 20)
    ratio = F.size("_heads") / F.greatest(F.size("_paras"), F.lit(1))
    risk = sum((x.cast("int") for x in (F.size("_words") < 100, F.size(boiler) > 0, F.coalesce("n_alike", F.lit(0)) > 3, ratio > 0.7)), F.lit(0))
    return {
        "boilerplate": boiler, "repeated_sentences": F.coalesce("n_alike", F.lit(0)).cast("bigint"), "repeated_paragraphs": (F.size(norm) - F.size(F.array_distinct(norm))).cast("bigint"), "heading_ratio": F.bround(ratio, 2),
        "skeleton_page": ratio > 0.7, "thin_risk": F.when(risk == 0, "none").when(risk == 1, "low").when(risk == 2, "medium").otherwise("high"),
    }


def anchors(domain: Column | None = None) -> dict[str, Column]:
    """Classes of anchor texts, kinds of targets, alternative texts of images; an image's text counts as an anchor too."""
    pair = r"\[([^\]]*)\]\(([^)]*)\)"
    text, target = (F.transform(F.regexp_extract_all("_md", F.lit(pair), F.lit(k)), U.trim) for k in (1, 2))
    low = F.transform(text, F.lower)
    kind = F.transform(low, lambda a: F.when(a == "", "empty").when(a.rlike("^https?://"), "naked").when(a.isin(*GENERIC), "generic").when((F.size(F.filter(X.tokens(a), lambda w: ~w.isin(*X.STOP["en"]))) >= 2) | (F.size(F.split(a, r"\s+")) >= 2), "descriptive").otherwise("partial"))
    n = lambda k: F.size(F.filter(kind, lambda x: x == k)).cast("bigint")
    share = F.when(F.size(kind) > 0, n("descriptive") / F.size(kind)).otherwise(F.lit(1.0))
    own = lambda u: u.startswith("/") | ((domain != "") & u.contains(domain) if domain is not None else F.lit(False)) | ~u.rlike("^https?://")
    alts = F.transform(F.regexp_extract_all("_md", F.lit(r"!\[([^\]]*)\]\([^)]*\)"), F.lit(1)), U.trim)
    missing = F.size(F.filter(alts, lambda a: a == ""))
    return {
        **{f"anchors_{k}": n(k) for k in ("descriptive", "partial", "generic", "naked", "empty")}, "anchor_ratio": F.bround(share, 2),
        "anchor_score": F.when(share > 0.8, "excellent").when(share >= 0.6, "good").when(share >= 0.4, "fair").otherwise("poor"), "links_internal": F.size(F.filter(target, own)).cast("bigint"),
        "links_external": F.size(F.filter(target, lambda u: ~own(u))).cast("bigint"), "images": F.size(alts).cast("bigint"), "images_without_alt": missing.cast("bigint"),
        "alt_coverage": F.when(F.size(alts) > 0, F.bround((F.size(alts) - missing) / F.size(alts), 4)).otherwise(F.lit(1.0)),
    }


def syllables(w: Column) -> Column:
    """Clusters of vowels, less a silent e at the end, one at least."""
    n = F.regexp_count(F.lower(w), F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), n - (F.lower(w).endswith("e") & (n > 1)).cast("int"))


def readability() -> dict[str, Column]:
    """Reading ease by the language's formula, fog index, lengths of sentences; null where there is no sentence of three words."""
    s = F.filter(F.transform(F.split("_plain", "[.!?]+"), U.trim), lambda x: F.size(F.split(x, r"\s+")) >= 3)
    w = F.regexp_extract_all("_plain", F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]+(?![\p{L}\p{N}_])"), F.lit(0))
    lens = F.transform(s, lambda x: F.regexp_count(x, F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]{3,}(?![\p{L}\p{N}_])")))
    n, k = F.size(w), F.size(s)
    ok = (n > 0) & (k > 0)
    asl, syl = n / k, F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x)) / n
    hard = F.size(F.filter(w, lambda x: (syllables(x) >= 3) & ~x.rlike("^[A-Z]"))) / n
    clamp = lambda x: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)), 1)
    score = by_language(F.col("_lang"), lambda k_: {"de": F.bround(0.2656 * asl + 27.44 * hard - 169.3 * k / n - 1.1628, 1), "es": clamp(206.84 - 60.0 * syl - 1.02 * asl)}.get(k_, clamp(206.835 - 1.015 * asl - 84.6 * syl)))
    ease = lambda x: F.when(x >= 70, "easy").when(x >= 50, "moderate").when(x >= 30, "difficult").otherwise("academic")
    level = F.when(F.col("_lang") == "de", F.when(score <= 8, "easy").when(score <= 11, "moderate").when(score <= 14, "difficult").otherwise("academic")).otherwise(ease(score))
    return {
        "sentence_count": F.when(n > 0, k).otherwise(0).cast("bigint"), "reading_ease": F.when(ok, score), "reading_level": F.when(ok, level).otherwise("unknown"), "fog_index": F.when(ok, F.bround(0.4 * (asl + 100 * hard), 1)),
        "long_sentences": F.when(ok, F.size(F.filter(lens, lambda x: x > 30))).otherwise(0).cast("bigint"), "short_sentences": F.when(ok, F.size(F.filter(lens, lambda x: x < 5))).otherwise(0).cast("bigint"),
        "sentence_p50": F.when(ok, X.nearest_rank(lens, 0.5)), "sentence_p90": F.when(ok, X.nearest_rank(lens, 0.9)),
    }


def style() -> dict[str, Column]:
    """Calls to action, contents, author's note, passive voice, transitions, the first paragraph, skips of heading levels."""
    low, lang, md = F.col("_low"), F.col("_lang"), F.col("_md")
    calls = by_language(lang, lambda k: found(low, CALLS[k], True))
    lines = F.split(md, "\n")
    top = F.array_join(F.slice(lines, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(lines) / 5).cast("int"))), "\n")
    listed, plain = count(top, r"(?m)^(?:[-*+]|\d+\.)\s+\[.+\]\(#\S+\)"), count(top, r"\[.+?\]\(#\S+?\)")
    entries = F.when((listed < 3) & (plain >= 3), plain).otherwise(listed)
    w = F.size("_words")
    passive = count(F.col("_plain"), PASSIVE)
    trans = by_language(lang, lambda k: sum((count(low, rf"\b{x}\b") for x in X.TRANSITIONS[k]), F.lit(0).cast("bigint")))
    ratio = F.when(w > 0, F.bround(trans / w, 4)).otherwise(F.lit(0.0))
    body = X.strip_markdown(F.regexp_replace(md, r"(?m)^\s*#{1,6}\s+.*$", ""))
    first = F.coalesce(F.get(F.filter(F.transform(F.split(body, r"\n\n+"), U.trim), lambda p: p != ""), F.lit(0)), F.lit(""))
    long_words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]{3,}(?![\p{L}\p{N}_])"), F.lit(0))
    hook = F.substring(first, 1, 200).contains("?") | F.substring(first, 1, 1).isin('"', "“", "'", "‘", "«") | first.rlike(CLAIM)  # the sign of a question counts within the first 200
    skips = F.filter("_heads", lambda h, i: F.coalesce(h["level"] > F.get("_heads", i - 1)["level"] + 1, F.lit(False)))
    return {
        "calls": calls, "contents_entries": entries, "has_contents": entries >= 3, "contents_advised": (w > 1500) & (entries < 3), "author_bio": by_language(lang, lambda k: F.col("_plain").rlike("(?i)" + AUTHOR_BIO[k])),
        "passive": passive, "passive_ratio": F.when(w > 0, F.bround(passive / w, 4)).otherwise(F.lit(0.0)), "transitions": trans, "transition_ratio": ratio,
        "transition_label": F.when(ratio < 0.01, "low").when(ratio < 0.03, "moderate").otherwise("good"), "intro_words": n_words(first).cast("bigint"),
        "intro_has_title": (first != "") & F.arrays_overlap(long_words(F.col("_title")), long_words(first)), "intro_hook": (first != "") & hook, "heading_skips": F.size(skips).cast("bigint"),
    }


def description_status(text: Column) -> Column:
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "missing").when(n < 120, "too_short").when(n <= 160, "optimal").otherwise("too_long")


def score() -> Column:
    """100 less the deductions of each signal, 0 at least."""
    less = [
        (F.col("depth_label") == "thin", 15), (F.col("depth_label") == "short", 7), (~F.col("title_in_h1"), 10), (~F.col("title_in_intro"), 5), (F.col("heading_alignment") < 0.5, 5), (F.col("stuffed"), 15),
        (F.col("trust_signals") == 0, 20), (F.col("trust_signals") == 1, 12), (F.col("trust_signals") == 2, 6), (F.col("freshness") == "very_stale", 10), (F.col("freshness") == "stale", 5),
        (F.col("thin_risk") == "high", 20), (F.col("thin_risk") == "medium", 10), (F.col("thin_risk") == "low", 5), (F.col("anchor_score") == "poor", 10), (F.col("anchor_score") == "fair", 5),
        (F.col("reading_level") == "academic", 10), (F.col("reading_level") == "difficult", 5),
    ]
    return F.greatest(F.lit(0), F.lit(100) - sum((F.when(c, n).otherwise(0) for c, n in less), F.lit(0))).cast("bigint")


def score_label(s: Column) -> Column:
    return F.when(s >= 80, "excellent").when(s >= 60, "good").when(s >= 40, "needs_work").when(s.isNotNull(), "poor")


def issues() -> Column:
    """The codes of what is wrong, in the order of the signals."""
    c = F.col
    codes = [
        (c("depth_label") == "thin", "thin content"), (c("depth_label") == "short", "short content"), (~c("title_in_h1"), "title not in h1"), (~c("title_in_intro"), "title not in introduction"),
        (c("heading_alignment") < 0.5, "headings unlike their sections"), (c("stuffed"), "keyword stuffing"), (c("trust_label") == "weak", "weak trust signals"), (c("timely_without_date_near"), "words of time without a date"),
        (c("freshness") == "very_stale", "very old"), (c("freshness") == "stale", "old"), (F.size("boilerplate") > 0, "boilerplate"), (c("repeated_sentences") > 3, "repeated sentences"), (c("skeleton_page"), "more headings than text"),
        (c("anchor_score") == "poor", "poor anchors"), (c("anchor_score") == "fair", "fair anchors"), (c("reading_level") == "academic", "academic reading level"), (c("reading_level") == "difficult", "difficult reading level"),
        (c("long_sentences") > 3, "long sentences"), (c("contents_advised"), "no table of contents"), (c("heading_skips") > 0, "heading levels skipped"), (c("description_status") == "missing", "description missing"),
        (c("description_status") == "too_short", "description too short"), (c("description_status") == "too_long", "description too long"), (c("images_without_alt") > 0, "images without alternative text"), (c("transition_label") == "low", "few transition words"),
    ]
    return F.concat("depth_issues", F.filter(F.array(*(F.when(x, F.lit(k)) for x, k in codes)), lambda x: x.isNotNull()))


def alike_sentences(df: DataFrame, id_col: str, md_col: str, share: float = 0.8) -> DataFrame:
    """(id, n_alike): pairs of sentences of a text, of more than 20 characters, that have more than `share` of the words of the longer one in common.

    An exact prefix join within each text: of two such sentences of n and m words the first n - floor(share n) and m -
    floor(share m) words in the order of their hashes have one in common, so only sentences with such a word are compared.
    """
    s = df.select(id_col, F.posexplode(F.split(F.lower(X.strip_markdown(F.coalesce(F.col(md_col), F.lit("")))), "[.!?]+")).alias("at", "s"))
    w = F.array_distinct(F.regexp_extract_all("s", F.lit(X.WORDS), F.lit(0)))
    s = s.filter(F.length(U.trim(F.col("s"))) > 20).select(id_col, "at", F.array_sort(F.transform(w, lambda x: F.xxhash64(x))).alias("w")).filter("size(w) > 0")
    prefix = F.slice("w", F.lit(1), F.size("w") - F.floor(F.lit(share) * F.size("w") + F.lit(1e-9)).cast("int"))
    keyed = s.select(id_col, "at", F.size("w").alias("n"), F.explode(prefix).alias("g"))
    side = lambda k: keyed.select(id_col, F.col("at").alias(k), F.col("n").alias(f"n{k}"), "g")
    pairs = side("a").join(side("b"), [id_col, "g"]).filter((F.col("a") < F.col("b")) & (F.least("na", "nb") > F.lit(share) * F.greatest("na", "nb"))).select(id_col, "a", "b").distinct()
    words = lambda k: s.select(id_col, F.col("at").alias(k), F.col("w").alias(f"w{k}"))
    both = pairs.join(words("a"), [id_col, "a"]).join(words("b"), [id_col, "b"])
    return both.filter(F.size(F.array_intersect("wa", "wb")) / F.greatest(F.size("wa"), F.size("wb")) > share).groupBy(id_col).agg(F.count("*").alias("n_alike"))


def analyse(df: DataFrame, id_col: str, md_col: str, title_col: str, description_col: str, url_col: str | None = None, year: int | None = None) -> DataFrame:
    """(id, language, every signal, description_status, score, label, issues) of each text, which ids must name uniquely.

    year: the year by which age is judged, the current one by default.
    """
    d = df.join(alike_sentences(df, id_col, md_col), id_col, "left")
    d = prepared(d, md_col, title_col).withColumn("_year", F.lit(year) if year else F.year(F.current_date()))
    signals = depth() | relevance() | trust(F.col("_year")) | snippets() | thin() | anchors(U.host(F.col(url_col)) if url_col else None) | readability() | style()
    d = d.select(id_col, F.col("_lang").alias("language"), *(c.alias(k) for k, c in signals.items()), description_status(F.col(description_col)).alias("description_status"))
    return d.withColumn("score", score()).withColumn("label", score_label(F.col("score"))).withColumn("issues", issues())


def top_keywords(df: DataFrame, id_col: str, md_col: str, k: int = 10) -> DataFrame:
    """(id, word, n, percentage, rank) of the most frequent words of each text that aren't stop words, ties by first occurrence."""
    d = prepared(df, md_col, None)
    t = d.select(id_col, without_stops(X.tokens(F.col("_plain")), F.col("_lang")).alias("w")).select(id_col, F.size("w").alias("all"), F.posexplode("w").alias("pos", "word"))
    g = t.groupBy(id_col, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.first("all").alias("all"))
    return top_per_group(g, id_col, [F.desc("n"), F.col("first")], k).select(id_col, "word", "n", F.round(F.col("n") / F.col("all") * 100, 2).alias("percentage"), F.col("rn").cast("bigint").alias("rank"))


def top_phrases(df: DataFrame, id_col: str, md_col: str, size: int, k: int = 10) -> DataFrame:
    """(id, phrase, n, percentage, rank): phrases of `size` words that occur twice or more and have a word of three letters that isn't a stop word."""
    d = prepared(df, md_col, None)
    w = d.select(id_col, F.col("_lang").alias("_lang"), X.tokens(F.col("_plain")).alias("w")).filter(F.size("w") >= size)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda i: F.slice("w", i, F.lit(size)))
    t = w.select(id_col, "_lang", F.size("w").alias("all"), F.posexplode(grams).alias("pos", "g"))
    g = t.groupBy(id_col, "g").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.first("all").alias("all"), F.first("_lang").alias("_lang")).filter("n >= 2")
    content = by_language(F.col("_lang"), lambda x: F.exists("g", lambda y: ~y.isin(*X.STOP[x]) & (F.length(y) >= 3)))
    g = g.filter(content)
    return top_per_group(g, id_col, [F.desc("n"), F.col("first")], k).select(id_col, F.array_join("g", " ").alias("phrase"), "n", F.round(F.col("n") / F.greatest(F.col("all") - (size - 1), F.lit(1)) * 100, 2).alias("percentage"), F.col("rn").cast("bigint").alias("rank"))


def script_language(t: Column, guess: Column) -> Column:
    """ko, ja or zh where more than 30 % of a text's characters are of those scripts, else the guess."""
    n = lambda p: F.regexp_count(t, F.lit(p))
    cjk = n(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]")
    return F.when(cjk > 0.3 * F.length(t), F.when(n(r"[\x{ac00}-\x{d7af}]") > 0.5 * cjk, "ko").when(n(r"[\x{3040}-\x{30ff}]") > 0, "ja").otherwise("zh")).otherwise(guess)


def volume(t: Column, lang: Column) -> dict[str, Column]:
    """Characters, words and minutes of reading; in scripts without blanks each sign is a word and 400 signs are a minute."""
    signs = F.length(F.regexp_replace(t, r"\s+", ""))
    cjk = lang.isin("ko", "ja", "zh")
    w = F.when(cjk, F.regexp_count(t, F.lit(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]")) + F.regexp_count(t, F.lit(r"[a-zA-Z0-9]+"))).otherwise(n_words(t)).cast("bigint")
    return {"n_chars": F.length(t).cast("bigint"), "n_signs": signs.cast("bigint"), "n_words": w, "minutes": F.when(cjk, F.bround(signs / 400.0, 1)).otherwise(F.bround(w / 200.0, 1))}


def chrome_ratio(words: Column, raw_words: Column) -> Column:
    """Words of the content by all words of the html; null where those are unknown or none."""
    return F.when(raw_words > 0, F.bround(words / raw_words, 3))


def inventory(md: Column, links: int = 200, images: int = 100) -> dict[str, Column]:
    """The first links and images of a markdown, as many as a report lists, with flags that tell of more; and its first h1."""
    target = F.regexp_extract_all(md, F.lit(r"(?<!!)\[[^\]]*\]\(([^)]*)\)"), F.lit(1))
    image = F.regexp_extract_all(md, F.lit(r"!\[[^\]]*\]\(([^)]*)\)"), F.lit(1))
    h1 = F.get(F.filter(headings(md), lambda h: h["level"] == 1), F.lit(0))["text"]
    return {"links": F.slice(target, 1, links), "links_truncated": F.size(target) > links, "images": F.slice(image, 1, images), "images_truncated": F.size(image) > images, "first_h1": h1}


def per_thousand(n: Column, words: Column) -> Column:
    """How many for 1,000 words, 1 decimal; 0 for a text without words."""
    return F.when(words > 0, F.bround(n * 1000 / words, 1)).otherwise(F.lit(0.0))
