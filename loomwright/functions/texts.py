"""Text expressions: words, sentences, percentiles, readability, issues. JVM expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .urls import trim

WORDS = r"[\p{L}\p{N}_]+"
ASCII_WORDS = r"[a-zA-Z]{2,}"
# Stop words, transition words and the forms of readability by language. Fixed values.
STOP = {
    "en": (
        "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
        "with", "by", "from", "as", "is", "was", "are", "were", "be", "been",
        "being", "have", "has", "had", "do", "does", "did", "will", "would",
        "could", "should", "may", "might", "can", "this", "that", "these",
        "those", "it", "its", "they", "them", "their", "we", "our", "you",
        "your", "i", "my", "he", "she", "his", "her", "not", "no", "so", "if",
        "about", "which", "who", "what", "when", "where", "how", "all", "any",
        "both", "also", "just", "more", "than", "then", "up", "out", "into",
    ),
    "de": (
        "der", "die", "das", "und", "oder", "ist", "sind", "war", "waren",
        "ein", "eine", "einem", "einer", "eines", "den", "dem", "des",
        "von", "mit", "auf", "in", "an", "bei", "zu", "als", "auch",
        "noch", "aber", "wenn", "dann", "nicht", "sich", "es", "sie",
        "er", "wir", "ihr", "ich", "du", "mein", "meine", "sein",
        "seine", "unser", "unsere", "dieser", "diese", "dieses", "jede",
        "jeder", "alle", "mehr", "so", "wie", "was", "wo", "wann", "wer",
    ),
    "es": (
        "el", "la", "los", "las", "un", "una", "unos", "unas", "y", "o", "es",
        "son", "era", "eran", "ser", "estar", "de", "en", "con", "por", "para",
        "que", "como", "pero", "si", "no", "se", "su", "sus", "mi", "tu",
        "yo", "nosotros", "ellos", "ellas", "este", "esta", "estos", "estas",
        "al", "del", "le", "les", "lo", "también", "ya", "cuando", "donde",
    ),
}
TRANSITIONS = {
    "en": (
        "however", "therefore", "furthermore", "additionally", "moreover",
        "consequently", "nevertheless", "although", "meanwhile", "subsequently",
        "accordingly", "thus", "hence", "otherwise", "nonetheless",
    ),
    "de": (
        "jedoch", "daher", "außerdem", "zusätzlich", "darüber hinaus",
        "folglich", "dennoch", "obwohl", "inzwischen", "anschließend",
    ),
    "es": (
        "sin embargo", "por lo tanto", "además", "asimismo", "no obstante",
        "en consecuencia", "aunque", "mientras tanto", "posteriormente",
    ),
}


def words(t: Column) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(WORDS), F.lit(0)), lambda w: F.lower(w))


def tokens(t: Column) -> Column:
    """All-ASCII words of two letters and more; a word with another letter in it is none."""
    return F.transform(F.filter(F.regexp_extract_all(t, F.lit(WORDS), F.lit(0)), lambda w: w.rlike(r"^[a-zA-Z]{2,}$")), lambda w: F.lower(w))


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"[.!?]+"), lambda s: trim(s)), lambda s: s != "")


def paragraphs(t: Column) -> Column:
    return F.filter(F.split(t, r"\n{2,}"), lambda s: trim(s) != "")


def nearest_rank(xs: Column, p: float) -> Column:
    """The element at round-half-even(p * (n - 1)) of the sorted array; null for an empty one."""
    s = F.array_sort(xs)
    return F.when(F.size(xs) > 0, F.element_at(s, (F.bround(F.lit(p) * (F.size(xs) - 1), 0).cast("int") + 1)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: functions of arrays aren't shared by the planner."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def guess_language(t: Column) -> Column:
    """The language with the most different frequent words; of equals the first listed."""

    def first(n: Column) -> Column:
        out = F.lit("en")
        for k in reversed(list(STOP)):
            out = F.when(n[k] == F.greatest(*(n[x] for x in STOP)), F.lit(k)).otherwise(out)
        return out

    counts = let(F.array_distinct(tokens(t)), lambda w: F.struct(*(F.size(F.array_intersect(w, F.array(*map(F.lit, v)))).alias(k) for k, v in STOP.items())))
    return let(counts, first)


def diversity(t: Column) -> Column:
    w = words(t)
    return F.when(F.size(w) > 0, F.bround(F.size(F.array_distinct(w)) / F.size(w), 3)).otherwise(F.lit(0.0))


def depth_label(n: Column) -> Column:
    return F.when(n < 100, "thin").when(n < 300, "short").when(n < 800, "adequate").otherwise("comprehensive")


def strip_markdown(t: Column) -> Column:
    """The text without code, images, the targets of links, marks of headings, emphasis, quotes and rules; blank lines and blanks collapsed."""
    for pattern, put in (
        (r"(?s)```.*?```", ""), (r"`[^`]*`", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""),
        (r"\*{1,3}([^*]*)\*{1,3}", "$1"), (r"_{1,3}([^_]*)_{1,3}", "$1"), (r"(?m)^>\s+", ""), (r"(?m)^[-*_]{3,}\s*$", ""), (r"\n{3,}", "\n\n"), (r"[ \t]+", " "),
    ):
        t = F.regexp_replace(t, pattern, put)
    return trim(t)


def content_hash(t: Column) -> Column:
    """The 32-bit hash h = 31 h + c over the first 2,000 code points, which is how the hash is defined."""
    chars = F.filter(F.split(F.substring(t, 1, 2000), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint")), F.lit(0).cast("bigint"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(4294967295)))


def trigrams(t: Column) -> Column:
    s = F.lower(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.length(s) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: s.substr(i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
