"""Clause structure, repeated text and placeholders of one page's body. Plain Python over whole texts."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate, count

from .blocks import LINK, Block, _chars, cjk_chars

# Frequent function words of the languages of the corpus, without those that also bind nouns in product names. Fixed values.
FUNCTION = frozenset(
    """the a an and but because while of with without for near as by from this that these those their our your its his her
    is are was were be been has have had will would can could not no we you they it he she to into about after before during since every most
    der die das den dem des ein eine einen einem einer eines und aber denn oder nicht mit ohne bei nach vor seit während trotz ist sind war
    wird werden hat haben wir sie es er ihr unser unsere dieses dieser diese jeder alle auf aus zu zum zur von vom
    el los las un una unos unas y pero porque mientras con sin cerca según es son fue ha han se su sus nuestro nuestra este esta cada que por al lo
    o os as um uma e mas porque enquanto com sem perto segundo é são foi tem seu sua nosso nossa cada que por ao à da do das dos no nas nos pelo pela
    le la les une et mais car pendant avec sans près selon est sont a ont ce cette chaque notre leur leurs que qui par au aux dans sur ne pas vous nous il elle du des
    и но а потому что пока с без возле на не из у до после во за этот эта это каждый наш наша их его её все всей в к о от
    ist im""".split()
)
SENT = re.compile(r"[^.!?。！？\n]+[.!?。！？]*[\"'”»«“)\]*_]*")
TOKEN = re.compile(r"[^\W_]+|[぀-ヿ㐀-鿿]")
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|<%=?[^%\n]{1,60}%>|<<[^<>\n]{1,60}>>|\[\[[^\[\]\n]{1,60}\]\]|@@[\w. ]{1,60}@@|__[A-Za-z][\w.]{0,60}?__|"
    r"%[A-Za-z][\w.]{1,60}%|(?<![\w\]!])\[[A-Za-z][A-Za-z_.]{2,60}\](?!\()|(?<![\w$#{])\{[A-Za-z][\w.]{1,60}\}"
)
VERB_RU = re.compile(r"[а-яё]{3,}(?:ет|ит|ют|ут|ят|ат|ется|ится)\b")
DIGIT = re.compile(r"\d")
TAG = re.compile(r"(?<![\w&])#[^\W\d_][\w-]*")
LONG = 8  # characters from which a repeated substring counts
KANA_PARTICLE = re.compile(r"[をはがにで]")


@lru_cache(maxsize=4096)  # one page asks for the same sentence several times
def is_clause(s: str) -> bool:
    """A sentence with an end, enough words and function words; in Japanese, enough signs and particles."""
    s = s.strip().rstrip("\"'”»«“)]*_ ")
    if len(s) < 12 or s[-1] not in ".!?。！？":
        return False
    plain = s.isascii()
    if cjk_chars(s) * 2 >= len(s):
        return len(s) >= 12 and len(KANA_PARTICLE.findall(s)) >= 2
    low = s.lower()
    words = (low if plain else low.replace("’", " ").replace("«", " ").replace("“", " ")).replace("'", " ").split()
    if len(words) < 5 or DIGIT.search(s) and sum(bool(DIGIT.search(w)) for w in words) * 5 > len(words):
        return False
    n = 0
    for w in words:
        if w.strip(".,!?;:()") in FUNCTION:
            n += 1
            if n == 2:
                return True
    return not plain and bool(VERB_RU.search(low))


def is_sentence(s: str) -> bool:
    """A sentence by its form alone, in any language: an end, five words (in Japanese twelve signs), few of them with digits."""
    s = s.strip().rstrip("\"'”»«“)]*_ ")
    if len(s) < 12 or s[-1] not in ".!?。！？":
        return False
    if cjk_chars(s) * 2 >= len(s):
        return True
    words = s.split()
    return len(words) >= 5 and (not DIGIT.search(s) or sum(bool(DIGIT.search(w)) for w in words) * 5 <= len(words))


def sentences(b: Block) -> list[str]:
    return SENT.findall(b.plain)


def clause_chars(blocks: list[Block]) -> tuple[int, int]:
    """(characters in clauses, all characters) of the running text; headings, tables, code and images are left out."""
    inside = total = 0
    for b in blocks:
        if b.kind in ("p", "list", "quote"):
            for s in sentences(b):
                n = _chars(s)
                total += n
                if is_clause(s):
                    inside += n
    return inside, total


def mostly_clauses(blocks: list[Block], share: float, least: int) -> bool:
    """Whether clauses hold `share` of the running text's characters and `least` characters; no sentence is looked at beyond that."""
    some = [b for b in blocks if b.kind in ("p", "list", "quote")]
    need = max(least, share * sum(b.c for b in some))
    inside = 0
    for b in some:
        for s in sentences(b):
            if is_clause(s):
                inside += _chars(s)
                if inside >= need:
                    return True
    return False


def repeated_chars(text: str, least: int = 3, shortest: int = 1) -> tuple[int, int]:
    """(characters covered by substrings of `shortest` characters or more that occur `least` times or more, characters of all tokens).

    The text's suffix automaton over its words (signs, in Japanese) is built; for each end position the longest
    repeated substring is the first suffix link ancestor whose end positions are `least` or more, so what is covered
    is the union of the repeated maximal substrings. Linear in the text.
    """
    tokens = TOKEN.findall(text.lower())
    n = len(tokens)
    if not n:
        return 0, 0
    nxt: list[dict[str, int]] = [{}]
    link, length, often = [-1], [0], [0]
    last = 0
    ends = []
    for tok in tokens:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        often.append(1)
        p = last
        while p >= 0 and tok not in nxt[p]:
            nxt[p][tok] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][tok]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                often.append(0)
                while p >= 0 and nxt[p].get(tok) == q:
                    nxt[p][tok] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
        ends.append(cur)
    for v in sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True):
        often[link[v]] += often[v]
    best = [0] * len(nxt)  # the longest suffix of a state with enough end positions
    for v in sorted(range(1, len(nxt)), key=length.__getitem__):
        best[v] = length[v] if often[v] >= least else best[link[v]]
    covered = 0
    upto = [0, *accumulate(3 * len(x) if "぀" <= x <= "鿿" else len(x) for x in tokens)]  # a Japanese sign weighs as three letters
    reach = n  # positions from reach on are covered already, seen from the right
    for i in range(n - 1, -1, -1):
        a = i - best[ends[i]] + 1
        if a <= i and upto[i + 1] - upto[a] >= shortest:
            lo, hi = a, min(i + 1, reach)
            if lo < hi:
                covered += upto[hi] - upto[lo]
                reach = lo
    return covered, upto[n]


def outside_links(blocks: list[Block]) -> int:
    """Characters of link labels in list items or lines that are links only."""
    out = 0
    for b in blocks:
        if b.kind in ("p", "list") and b.lt:
            rest = _chars(LINK.sub("", b.text)) - (b.t if b.kind == "list" else 0)
            if rest <= b.lc * 0.5 + 2 * b.lt:
                out += b.lc
    return out


def tag_chars(text: str) -> int:
    """Characters of product tags: words behind a # sign."""
    return sum(len(m[0]) for m in TAG.finditer(text))


def spam_features(blocks: list[Block]) -> tuple[float, float, float, int]:
    """(share of clauses, share covered by repeats, share of bare links and tags, characters) of the running text of a body.

    Only substrings of LONG characters or more that occur three times count as repeated; every placeholder counts as another word.
    """
    inside, total = clause_chars(blocks)
    some = [b for b in blocks if b.kind in ("p", "list", "quote")]
    each = count()
    text = PLACEHOLDER.sub(lambda m: f" {next(each)}{''.join(TOKEN.findall(m[0]))} ", "\n".join(b.text for b in some))
    covered, all_ = repeated_chars(text, shortest=LONG)
    bare = outside_links(blocks) + tag_chars("\n".join(b.plain for b in some))
    return inside / total if total else 0.0, covered / all_ if all_ else 0.0, bare / total if total else 0.0, total
