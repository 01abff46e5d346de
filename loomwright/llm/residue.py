"""Residue that shows by its form: placeholders, filler Latin, traces, error codes and reason phrases, request numbers and working marks.

No wording of the texts is listed here but the reason phrases of HTTP. Residue in words (error messages, notices, filler sentences) is found by its
links to pages that show such forms, see `pages.residue_pages`.
"""

from __future__ import annotations

import re

from .blocks import Block, _chars
from .clauses import PLACEHOLDER, clause_chars, is_clause

# Words of the common filler text and its generators. Fixed values.
LOREM = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam
    quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse cillum eu
    fugiat nulla nullam pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum donec
    tempus justo cursus porta massa felis erat pretium ornare vel vitae magnis lectus pellentesque vestibulum mauris nunc nec at ac eget libero risus viverra
    ligula""".split()
)
# Reason phrases of HTTP (RFC 9110) of the statuses from 400 on that pages show, and the language of scripts by its name. Fixed values.
NAMED = re.compile(
    r"\b(?:bad request|unauthorized|forbidden|not found|method not allowed|not acceptable|request timeout|gone|too many requests|internal server error|"
    r"not implemented|bad gateway|service unavailable|gateway timeout)\b|javascript", re.I
)
LATIN = 0.3  # share of such words from which a sentence is filler
TRACE = re.compile(r"^\s*at [\w$.<>]+ ?\((?:line )?[\w./:]*\d+\)|(?:error|exception|warning|notice)\b[^\n]{0,80}\(?[\w./-]+\.(?:php|py|js|rb|java|ts|jsp|aspx?)[:)]|traceback \(most recent|stack trace", re.I)
CODE = re.compile(r"^\W*(?:error\s*)?[45]\d\d\b", re.I)
REQUEST = re.compile(r"^\W*(?:request|ref(?:erence)?|err(?:or)?|trace|incident)[ _-]?(?:id|no|code)?[ _:#-]*[\w-]*\d[\w-]*\W*$|^\W*ERR_\w+\W*$", re.I)
BARE = re.compile(r"^\W*(?:todo|tbd|tba|n/?a|xxx+|test|demo|untitled|draft|sample)(?:\W+(?:todo|tbd|xxx+|test|\d+))*\W*$", re.I)
HEAD = re.compile(r"(?m)^\W*(?:(?:error\s*)?[45]\d\d\b|(?:request|ref|err|trace|incident)[ _-]?(?:id|no|code)?\b|todo|tbd|tba|xxx|test|demo|untitled|draft|sample)", re.I)
WORD = re.compile(r"[^\W\d_]+")


def lorem_share(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in LOREM for w in words) / len(words) if words else 0.0


def _hint(text: str) -> bool:
    """False only where no part of the text can count as residue."""
    return bool(PLACEHOLDER.search(text) or TRACE.search(text) or NAMED.search(text) or HEAD.search(text) or lorem_share(text) >= 0.2)


def residue_counts(blocks: list[Block]) -> tuple[int, int, int]:
    """(characters of residue, of clauses of the page's own, of other text), each different sentence once."""
    residue = own = other = 0
    if not _hint("\n".join(b.plain for b in blocks)):
        inside, total = clause_chars(blocks)
        return 0, inside, total - inside
    seen: set[str] = set()
    for b in blocks:
        if b.kind in ("image", "rule", "table"):
            continue
        if b.kind == "code":
            for line in b.lines:
                if TRACE.search(line):
                    residue += _chars(line)
            continue
        for line in b.plain.split("\n") if b.kind != "p" else [b.plain] if not (PLACEHOLDER.search(b.plain) or TRACE.search(b.plain)) else b.plain.split("\n"):
            marks = [m[0] for m in PLACEHOLDER.finditer(line)]
            if marks:
                rest = PLACEHOLDER.sub(" \n ", line)
                clauses = [s for s in re.split(r"(?<=[.!?。！？])\s+|\n", rest) if is_clause(s)]
                if not clauses and not is_clause(" ".join(rest.split())):
                    residue += _chars(line)
                    continue
                residue += sum(map(_chars, marks))
                line = rest.replace("\n", " ")
            if TRACE.search(line) or REQUEST.match(line):
                residue += _chars(line)
                continue
            if b.kind == "h" and CODE.match(line):
                residue += _chars(line)
                continue
            for s in re.split(r"(?<=[.!?。！？])\s*|\n", line):
                low = " ".join(s.lower().replace("*", " ").replace("_", " ").split())
                n = _chars(low)
                if not n or low in seen:
                    continue
                seen.add(low)
                if BARE.match(s) or REQUEST.match(s) or NAMED.search(s) or n >= 12 and lorem_share(low) >= LATIN:
                    residue += n
                elif b.kind == "h":
                    continue
                elif is_clause(s):
                    own += n
                else:
                    other += n
    return residue, own, other


def is_residue(blocks: list[Block], own_most: int = 250) -> bool:
    """Residue by its form makes up a third or more, or a heading opens with an error's code, and there is no full text of the page's own (`own_most` characters of clauses)."""
    residue, own, other = residue_counts(blocks)
    return residue > 0 and own < own_most and (residue * 3 >= residue + own + other or any(b.kind == "h" and CODE.match(b.plain) for b in blocks))
