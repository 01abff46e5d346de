"""Texts decoded with a wrong code page, found and restored.

A wrong code page is a substitution cipher over the letters outside ASCII: each letter became a unit of one or more
signs. Per source the table from units to letters is learned by expectation-maximization: the hidden letter of a unit
between the letters p and n has the probability theta(letter | unit) * T(p, letter, n), with T from the corpus' own
counts of letters in their contexts, all documents counted; theta starts at the units that known code pages
would give and a little on every other letter, and is re-estimated until it settles. A unit of one sign counts as garbled
where its letter is far likelier in its context than the unit itself, one of several signs also wherever the table of
known code pages has it; it is replaced by the source's table (translate). Only listed code pages (READ_AS, WRITTEN_AS) are found.
Texts whose every letter is enciphered (Cyrillic, Japanese) are read back page by page, and the reading whose
bigrams the corpus knows best wins. What was lost (U+FFFD) is found though it can't be restored.

Signs that are only spoken about are no case: a unit that stands alone in quotes, and one that stands alone in a line
which names a single letter of the kind as well.

The constants of the decision (0.02, 0.5 and others) are absolute, so that for rare contexts it depends on the size of the corpus.

Stages: the counts of contexts (one row for each context, bounded by the alphabets); the documents with anything odd
(a few per cent, written once); the units' contexts per source, again bounded by the alphabets, and a table for each
source; the decision by document. Defined results: null, empty and blank texts are no cases; a null source is a source of
its own; repeated rows of a doc_id give it once; rows without an id are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut, written

# Code pages by which texts are read, wrongly or rightly. Fixed values.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5", "cp932")
WRITTEN_AS = ("utf-8", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5", "cp932", "euc_jp")
# Letters and signs of the corpus' languages in Latin script outside ASCII. Fixed values.
LETTERS = "äöüßÄÖÜáéíóúñÁÉÍÓÚÑàâçèêëîïôùûÿœæÀÂÇÈÊËÎÏÔÙÛŒãõÃÕìòåø"
SIGNS = "“”‘’„‚–—…€£©®°«»¡¿•™·§"
RUN = re.compile(r"[^\x00-\x7f]+")
LONG_WORD = re.compile(r"[Ѐ-ӿ]{5,}")
CYRILLIC = re.compile(r"[Ѐ-ӿ]{3,}")
LATIN_RUN = re.compile(r"[À-ÖØ-öø-ÿ]{3,}")
LOST = re.compile(r"[�\x80-\x9f]|[｡-ﾟ]{2,}")
HIGH, HIGH_SIGN = re.compile(r"[^\x00-\x7f]"), re.compile(r"[^\x00-\x7f\s]")
HIRAGANA, KANA, HAN, JAPANESE = re.compile("[぀-ゟ]"), re.compile("[぀-ヿ]"), re.compile("[一-鿿]"), re.compile("[぀-ヿ、-。一-鿿]")
CYRILLIC_LETTER, TWICE = re.compile("[Ѐ-ӿ]"), re.compile("[ÃÐÑÂâ]")
ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}\d?|#\d{3,5});")
# Words of one letter outside ASCII. Fixed values.
ONE_LETTER = "àéèóôòùíîяыъøåö"
# Words by which a line speaks about a sign. Fixed values.
ABOUT = re.compile(r"\b(?:sign|symptom|character|symbol|zeichen|signo|símbolo|signe|caractère|sinal|caractere|знак|символ)\b|記号|文字|という印", re.I)
QUOTES = "“”‘’„‚\"'`«»「」『』()[]<>‹›"


def read_as(data: bytes, page: str) -> str | None:
    """The bytes under a code page; bytes that Windows pages leave open are control signs."""
    try:
        return data.decode(page)
    except UnicodeDecodeError:
        if page not in ("cp1252", "cp1251"):
            return None
        return "".join(_one(b, page) for b in data)


@lru_cache(maxsize=None)
def _one(b: int, page: str) -> str:
    try:
        return bytes([b]).decode(page)
    except UnicodeDecodeError:
        return chr(b)


@lru_cache(maxsize=None)
def _back(page: str) -> dict[str, int]:
    return {_one(b, page): b for b in range(256)}


def as_bytes(text: str, page: str) -> bytes | None:
    """The bytes that a code page shows as this text."""
    if page == "cp932":
        try:
            return text.encode(page)
        except UnicodeEncodeError:
            return None
    if page in ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "mac_cyrillic", "latin-1", "iso8859-5"):
        table = _back(page)
        try:
            return bytes([table[c] for c in text])
        except KeyError:
            return None
    return None


@lru_cache(maxsize=1)
def known_units() -> dict[str, Counter]:
    """unit -> the letters that it stands for under some pair of code pages, once more garbled too."""
    out: dict[str, Counter] = {}
    for letter in LETTERS + SIGNS:
        for written in WRITTEN_AS:
            try:
                data = letter.encode(written)
            except UnicodeEncodeError:
                continue
            for page in READ_AS:
                unit = read_as(data, page)
                if unit and unit != letter and not unit.isascii() and len(unit) <= 4:
                    out.setdefault(unit, Counter())[letter] += 1
                    if written == "utf-8" and page in ("cp1252", "latin-1"):
                        twice = read_as(unit.encode("utf-8"), page)
                        if twice and len(twice) <= 8:
                            out.setdefault(twice, Counter())[letter] += 1
    return out


@lru_cache(maxsize=1)
def proper() -> frozenset[str]:
    return frozenset(LETTERS + SIGNS)


@lru_cache(maxsize=1)
def odd_signs() -> frozenset[str]:
    """Signs that code pages show for bytes from 128 on, which the languages don't use."""
    out = {_one(b, p) for p in READ_AS[:10] for b in range(128, 256)}
    return frozenset(c for c in out if c not in proper() and not "Ѐ" <= c <= "ӿ" and c != " ")


@lru_cache(maxsize=1)
def odd_class() -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, sorted(odd_signs()))) + "]")


@lru_cache(maxsize=50_000)
def split_units(run: str) -> tuple[str, ...]:
    """A run of signs outside ASCII as known units (longest first), single signs otherwise."""
    known, out, i = known_units(), [], 0
    while i < len(run):
        for n in range(min(8, len(run) - i), 1, -1):
            if run[i : i + n] in known:
                out.append(run[i : i + n])
                i += n
                break
        else:
            out.append(run[i])
            i += 1
    return tuple(out)


def _cls(c: str) -> str:
    if c.isascii():
        return c.lower() if c.isalpha() else "0" if c.isdigit() else " "
    return "x" if c.isalpha() else " "


def _russian(unit: str) -> bool:
    return all("а" <= c <= "я" or "А" <= c <= "Я" or c in "ёЁ" for c in unit)


def units_in(line: str) -> Iterator[tuple[int, str, str, str]]:
    """(position, unit, class before, class after) of each unit of a line."""
    for m in RUN.finditer(line):
        at = m.start()
        for u in split_units(m[0]):
            if len(m[0]) > 1 and _russian(u):  # a letter of a Cyrillic word, not of a Latin one
                at += len(u)
                continue
            before = line[at - 1] if at else " "
            after = line[at + len(u)] if at + len(u) < len(line) else " "
            yield at, u, _cls(before), _cls(after)
            at += len(u)


# ------------------------------------------------------------------------------------------- counts of the corpus


def context_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, a, b, c, n): signs between their neighbours (t), and bigrams of Cyrillic words (r), over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(count)
            cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(4)] + [pa.array([count[k] for k in keys], pa.int64())]
            count.clear()
            return pa.RecordBatch.from_arrays(cols, ["kind", "a", "b", "c", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text or text.isascii():
                    continue
                for m in RUN.finditer(text):
                    run = m[0]
                    if len(run) <= 3:
                        for i, x in enumerate(run, m.start()):
                            count["t", _cls(text[i - 1]) if i else " ", x, _cls(text[i + 1]) if i + 1 < len(text) else " "] += 1
                    elif "Ѐ" <= run[0] <= "ӿ":
                        w = run.lower()
                        for x, y in zip(w, w[1:]):
                            count["r", x, y, ""] += 1
            if len(count) > 100_000:
                yield out()
        yield out()

    return docs.select(text_col).mapInArrow(run, "kind string, a string, b string, c string, n bigint").groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n"))


class Counts:
    """The corpus' counts: contexts of signs, and log probabilities of Cyrillic bigrams."""

    def __init__(self, rows: list) -> None:
        self.t = {(r["a"], r["b"], r["c"]): r["n"] for r in rows if r["kind"] == "t"}
        self.any = Counter()
        for (_, b, _), n in self.t.items():
            self.any[b] += n
        pairs = {(r["a"], r["b"]): r["n"] for r in rows if r["kind"] == "r"}
        total = sum(pairs.values()) or 1
        self.r = {k: math.log(n / total) for k, n in pairs.items() if n >= max(2, total * 1e-6)}
        self.floor = math.log(0.2 / total) if total > 1 else -12.0
        self.words: dict[str, float] = {}
        #: the mean of the language's own text
        self.native = sum(n / total * math.log(n / total) for n in pairs.values()) if total > 1 else -6.0

    def fits(self, a: str, letter: str, c: str) -> float:
        return self.t.get((a, letter, c), 0) + 0.02 * min(1.0, self.any.get(letter, 0) / 50)

    def cyrillic(self, text: str) -> float:
        """Mean log probability of the bigrams in Cyrillic words; the floor where there are none."""
        s = n = 0
        for w in CYRILLIC.findall(text.lower()):
            v = self.words.get(w)
            if v is None:
                if len(self.words) > 200_000:  # a memory of words, not of texts
                    self.words.clear()
                v = self.words[w] = sum(self.r.get(p, self.floor) for p in zip(w, w[1:]))
            s += v
            n += len(w) - 1
        return s / n if n else self.floor


# ------------------------------------------------------------------------------------------- one text


def lines_of(text: str) -> list[str]:
    return [html.unescape(x) if "&" in x and ENTITY.search(x) else x for x in text.split("\n")]


def mentioned(line: str, at: int, unit: str) -> bool:
    """Whether a unit is only spoken about: alone in quotes, or alone in a line that names a single letter too."""
    a, z = at, at + len(unit)
    while a and not (line[a - 1].isalnum() or line[a - 1].isspace() or line[a - 1] in QUOTES) and not line[a - 1].isascii():
        a -= 1
    while z < len(line) and not (line[z].isalnum() or line[z].isspace() or line[z] in QUOTES) and not line[z].isascii():
        z += 1
    left, right = line[:a].rstrip("   "), line[z:].lstrip("   ")
    if left[-1:] and left[-1] in QUOTES and right[:1] and right[0] in QUOTES:
        return True
    if ABOUT.search(line) and not (line[:a][-1:].isalnum() or line[z:][:1].isalnum()):
        return True
    alone = (not line[:a] or line[a - 1].isspace()) and (not line[z:] or line[z].isspace())
    return alone and any(len(x) == 1 and not x.isascii() and x != unit and (x.isalpha() or x in SIGNS) for x in re.split(r"[\s,.;:!?]+", line[:a] + " " + line[z:]))


def odd(text: str, counts: Counts) -> bool:
    """Whether anything in a text may be garbled."""
    if text.isascii():
        return "&" in text and bool(ENTITY.search(text))
    if LOST.search(text) or LATIN_RUN.search(text) or ENTITY.search(text):
        return True
    fine = proper()
    known = known_units()
    for m in RUN.finditer(text):
        run = m[0]
        if len(run) == 1 and run in fine:
            if run in known and (run.isupper() or run in SIGNS) and m.start() and text[m.start() - 1].islower() and m.end() < len(text) and text[m.end()].isalpha():
                return True
            if run in known:
                a, z = _cls(text[m.start() - 1]) if m.start() else " ", _cls(text[m.end()]) if m.end() < len(text) else " "
                own = counts.t.get((a, run, z), 0) + 0.02
                if any(counts.t.get((a, x, z), 0) > 20 * own for x in known[run]):
                    return True
            continue
        first = run[0]
        if "Ѐ" <= first <= "ӿ":
            continue
        if odd_class().search(run) or len(run) > 1 and any(len(u) > 1 for u in split_units(run)):
            return True
    words = CYRILLIC.findall(text)
    return bool(words) and any(len(w) >= 4 and counts.cyrillic(w) < counts.native - 1.5 for w in words)


def _japanese(text: str) -> float:
    n = len(HIGH_SIGN.findall(text))
    return len(JAPANESE.findall(text)) / n if n else 0.0


@lru_cache(maxsize=1)
def whole_pairs() -> tuple[tuple[str, str], ...]:
    return tuple((a, b) for a in READ_AS for b in WRITTEN_AS if b in ("utf-8", "cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5", "cp932", "euc_jp") and a != b)


def reread(piece: str, counts: Counts) -> str | None:
    """The right reading of a piece whose every letter is enciphered, or None."""
    high = len(HIGH.findall(piece))
    if high < 4 or len(HIRAGANA.findall(piece)) * 4 > high:
        return None
    here = counts.cyrillic(piece)
    best, gain = None, 1.0
    page, data = "", None
    for read, written in whole_pairs():
        if read != page:  # the bytes of a page are read in each way that it may have been written
            page, data = read, as_bytes(piece, read)
        if data is None:
            continue
        text = data.decode(written, "replace")
        if text.count("�") * 10 > len(text):
            continue
        if written == "utf-8" and len(TWICE.findall(text)) * 3 > len(text.split()) * 3 + 3:
            again = as_bytes(text, "cp1252")
            if again is not None:
                try:
                    text = again.decode("utf-8")
                except UnicodeDecodeError:
                    pass
        if HIRAGANA.search(text) and _japanese(text) > 0.9 and _japanese(piece) < 0.9:
            k = len(KANA.findall(text)) / max(1, len(text))
            if k > 0.2 and 6 + k > gain:
                best, gain = text, 6 + k
        elif CYRILLIC.search(text):
            cyr = len(CYRILLIC_LETTER.findall(text))
            fit = counts.cyrillic(text)
            if LONG_WORD.search(text) and cyr * 2 >= len(HIGH.findall(text)) and fit > counts.native - 1.5 and fit - here > gain:
                best, gain = text, fit - here
    return best


def pieces(line: str) -> list[str]:
    """A line's stretches, cut where ASCII words of three letters and more stand, since those weren't enciphered."""
    return [x for x in re.split(r"(?:[\x00-\x40\x5b-\x60\x7b-\x7f]*[A-Za-z]{3,}[\x00-\x40\x5b-\x60\x7b-\x7f]*)+", line) if x]


def _alone(u: str, a: str, c: str) -> bool:
    """Whether a single sign stands where nothing tells it from itself: a sign without a letter or digit beside it, a word of one letter."""
    if u in SIGNS or not u.isalpha() or _russian(u):
        return a in " x" and c in " x"
    return a == c == " " and u.lower() in ONE_LETTER


def judge(text: str, counts: Counts, table: dict[str, str]) -> tuple[bool, str]:
    """(whether a part of the text is garbled, the text with what can be restored)."""
    found = False
    out = []
    for raw, line in zip(text.split("\n"), lines_of(text)):
        new, hit = line, False
        if not line.isascii():
            for p in [line, *pieces(line)]:
                if p in new and (len(p) >= 4 and (LATIN_RUN.search(p) or CYRILLIC.search(p) or odd_class().search(p) or LOST.search(p) or HAN.search(p))):
                    good = reread(p.strip(" \r"), counts)
                    if good and not mentioned(line, line.index(p), p):
                        new, hit = new.replace(p.strip(" \r"), good), True
                        if p is line:
                            break
            parts, last = [], 0
            for at, u, a, c in units_in(new):
                letter = table.get(u)
                if letter and letter != u and not (len(u) == 1 and _alone(u, a, c)):
                    own = counts.fits(a, u, c) if len(u) == 1 else 0.0
                    there = counts.fits(a, letter, c)
                    if (len(u) > 1 and (there > 0.02 or u in known_units()) or there > 8 * own + 0.5) and not mentioned(new, at, u):
                        parts += [new[last:at], letter]
                        last, hit = at + len(u), True
                        continue
                if LOST.match(u) and not mentioned(new, at, u):
                    hit = True
            new = "".join([*parts, new[last:]])
            if not hit and (m := re.search(r"[｡-ﾟ]{2,}", new)) and not mentioned(new, m.start(), m[0]):
                hit = True
        found |= hit
        out.append(new if hit else raw)
    return found, "\n".join(out)


# ------------------------------------------------------------------------------------------- per source


def learn(unit: str, contexts: list[tuple[str, str, int]], counts: Counts, rounds: int = 12) -> str | None:
    """The letter that a unit of one source stands for, by expectation-maximization over its contexts (a, c, n); None if it stands for itself."""
    cand = known_units().get(unit, Counter())
    alphabet = [x for x in LETTERS + SIGNS if counts.any.get(x, 0) > 0] or list(LETTERS)
    letters = sorted({*alphabet, *cand})
    theta = np.array([0.002 + (1.0 if x in cand else 0.0) + (0.5 if x == unit else 0.0) for x in letters])
    theta /= theta.sum()
    fit = np.array([[counts.fits(a, x, c) + 1e-3 for x in letters] for a, c, _ in contexts])
    n = np.array([k for _, _, k in contexts], np.float64)
    for _ in range(rounds):
        q = fit * theta
        new = 1e-6 + (n / q.sum(1)) @ q
        new /= new.sum()
        moved = np.abs(new - theta).sum()
        theta = new
        if moved < 1e-3:
            break
    by = dict(zip(letters, theta.tolist()))
    best = max(by, key=lambda x: (by[x], x))
    if best != unit and by[best] > 0.4 and (best in cand or len(contexts) >= 5):
        return best
    # a proper letter that is a unit too: the likeliest other letter; each context decides
    return max(cand, key=lambda x: (by.get(x, 0), cand[x], x)) if cand else None


MOST_TABLES = 1000  # sources up to which their tables, some 20 KB each, are broadcast


def restored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, restored_text) of the garbled documents."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    # bounded by the alphabets, whatever the number of documents
    counts = spark.sparkContext.broadcast(Counts(context_counts(docs, text_col).collect()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(t) and odd(t, counts.value) for t in b.column(2).to_pylist()], pa.bool_()))

    some = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    some = cut(some.mapInArrow(keep, f"id {id_type}, source string, text string"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter = Counter()
            known = known_units()
            for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for line in lines_of(t):
                    for _, u, a, c in units_in(line):
                        if u in known or u in odd_signs():
                            count[s, u, a, c] += 1
            keys = list(count)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array([count[k] for k in keys], pa.int64())], ["source", "unit", "a", "c", "n"])

    ctx = some.mapInArrow(units, "source string, unit string, a string, c string, n bigint").groupBy("source", "unit", "a", "c").agg(F.sum("n").alias("n"))

    def em(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple, list] = {}
        for b in batches:
            for s, u, a, c, n in zip(*(b.column(k).to_pylist() for k in range(5))):
                rows.setdefault((s, u), []).append((a, c, n))
        found = [(s, u, x) for (s, u), v in rows.items() if (x := learn(u, sorted(v), counts.value))]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(3)], ["source", "unit", "letter"])

    # each unit is learned by itself, so the units of a source spread over the tasks; a source's units are bounded by the alphabets
    parts = max(8, spark.sparkContext.defaultParallelism)
    learned = ctx.repartition(parts, "source", "unit").mapInArrow(em, "source string, unit string, letter string")
    tables = written(learned.groupBy("source").agg(F.collect_list("unit").alias("units"), F.collect_list("letter").alias("letters")), "tables")
    tables = tables.withColumnRenamed("source", "_s")
    few = tables.count() <= MOST_TABLES
    both = some.join(F.broadcast(tables) if few else tables, some["source"].eqNullSafe(tables["_s"]), "left").select("id", "text", "units", "letters")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, texts = [], []
            memo: dict[tuple, dict[str, str]] = {}
            for i, (t, u, v) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))):
                table = memo.setdefault((tuple(u or ()), tuple(v or ())), dict(zip(u or (), v or ())))
                hit, new = judge(t, counts.value, table)
                if hit:
                    take.append(i)
                    texts.append(new)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(texts, pa.string())], ["id", "restored_text"])

    return both.mapInArrow(decide, f"id {id_type}, restored_text string").dropDuplicates(["id"])
