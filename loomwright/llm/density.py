"""Composite text density over a page's node tree (Sun, Song, Liao 2011): the subtree of the body and its threshold.

Every node of the tree has its characters ``C``, tags ``T``, link characters ``LC`` and link tags ``LT``; its link-adjusted
characters-per-tag are

    C/T * log_b( C/LC * T/LT ),   b = ln( C/nLC * LC + LCb/Cb * C + e )

with ``nLC = C - LC`` and ``LCb, Cb`` the link characters and characters of the whole page. The densities of a node's
children are summed; the node of the largest sum is the body's subtree, and the least density on the path from the page's
root to it is the threshold. Every piece of text (the text of one block element) gets a mark: INSIDE the subtree, DENSE where
the outermost node outside the path that holds it reaches the threshold, THIN where it doesn't. A dense container whose tag and
attributes are those of the subtree's root continues the body (INSIDE), unless thin ones are written so too.

Two cases in which the sums prove nothing: where the first heading of the first level stands outside the subtree, the title's
container (the outermost node that holds the title but not the subtree as well) takes its place; and where the subtree holds less
than LEAST characters or half of the page's unlinked text (a notice on a page that has little text), every mark is DENSE.

Plain Python over whole texts; the tree is held in lists, nothing recurses, so no depth of nesting is too large.
"""

from __future__ import annotations

import html as _html
import math
import re
from array import array
from itertools import zip_longest

import xxhash

THIN, DENSE, INSIDE = 0, 1, 2
LEAST = 250
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|head)\b.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>", re.S | re.I)
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SRC = re.compile(r"""\bsrc\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
BARE = bytes(i for i in range(128) if not chr(i).isalnum())  # signs of ASCII that aren't letters or digits
OTHER = re.compile(r"[^\w\x00-\x7f]+")  # and those beyond it


def composite(c: int, t: int, lc: int, lt: int, body_c: int, body_lc: int) -> float:
    """The link-adjusted density of one node."""
    if c <= 0:
        return 0.0
    lc_, lt_, t_ = lc or 1, lt or 1, t or 1
    ratio = c / lc_ * t_ / lt_
    if ratio <= 1.0:
        return 0.0
    base = math.log(c / (c - lc if c > lc else 1) * lc + body_lc / (body_c or 1) * c + math.e)
    return c / t_ * (math.log(ratio) / (base if base > 1.0 else 1.0))


def text_key(text: str) -> int:
    """64 bits of a piece's letters and digits, case dropped; 0 where it has none."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(None, BARE)
    if not data.isascii() and not (s := data.decode("utf-8", "surrogatepass")).isalnum():
        data = OTHER.sub("", s).encode("utf-8", "surrogatepass")
    return _signed(xxhash.xxh3_64_intdigest(data)) or 4 if data else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Tree:
    """Nodes in document order; node 0 is the page."""

    __slots__ = ("parent", "tag", "sign", "c", "t", "lc", "lt", "pieces", "title")

    def __init__(self) -> None:
        self.parent, self.tag = [-1], ["body"]
        self.sign = [""]  # the attributes as they are written
        self.c, self.t, self.lc, self.lt = [0], [0], [0], [0]
        self.pieces: list[tuple[int, int]] = []  # (node, key)
        self.title = -1  # the first heading of the first level


def html_tree(text: str) -> Tree:
    """The node tree of an html; scripts, styles, the head and noscript are left out."""
    tree = Tree()
    parent, tags, signs, pieces = tree.parent, tree.tag, tree.sign, tree.pieces
    stack, names, links = [0], ["body"], 0  # the open nodes and their tags
    words: list[str] = []  # of the piece that is open

    def flush() -> None:
        key = text_key("".join(words))
        words.clear()
        if key:
            pieces.append((stack[-1] if names[-1] not in INLINE else next((i for i, x in zip(reversed(stack), reversed(names)) if x not in INLINE), 0), key))

    # pieces of text, and between them the groups of what TOKEN matches
    parts = TOKEN.split(text)
    n_groups = TOKEN.groups + 1
    c = [0] * (len(parts) // n_groups + 1)  # there is at most a node for each match
    lc = c.copy()
    for s, closing, tag, attributes in zip_longest(parts[::n_groups], parts[2::n_groups], parts[3::n_groups], parts[4::n_groups]):
        if s and not s.isspace():
            if "&" in s:
                s = _html.unescape(s)
            words.append(s)
            n = len("".join(s.split()))
            c[stack[-1]] += n
            if links:
                lc[stack[-1]] += n
        if not tag:
            continue
        tag = tag.lower()
        if tag in ("html", "body"):
            continue
        if words and tag not in INLINE:
            flush()
        if closing:
            if tag in VOID:
                continue
            if names[-1] == tag:
                links -= tag == "a"
                stack.pop()
                names.pop()
            elif tag in names:
                k = len(names) - 1
                while names[k] != tag:
                    k -= 1
                links -= names[k:].count("a")
                del stack[k:], names[k:]
            continue
        node = len(parent)
        parent.append(stack[-1])
        signs.append(attributes)
        tags.append(tag)
        if tag == "img":
            m = SRC.search(attributes or "")
            if m and (key := text_key("img " + _html.unescape(m[1].strip("\"'")))):
                pieces.append((node, key))
        elif tag == "h1" and tree.title < 0:
            tree.title = node
        if tag not in VOID and not (attributes or "").endswith("/"):
            stack.append(node)
            names.append(tag)
            links += tag == "a"
    if words:
        flush()
    tree.c, tree.lc = c[: len(parent)], lc[: len(parent)]
    tree.t, tree.lt = [0] + [1] * (len(parent) - 1), [int(x == "a") for x in tags]
    return _summed(tree)


def _summed(tree: Tree) -> Tree:
    parent, c, t, lc, lt = tree.parent, tree.c, tree.t, tree.lc, tree.lt
    for i in range(len(parent) - 1, 0, -1):  # children come after their parents
        p = parent[i]
        c[p] += c[i]
        t[p] += t[i]
        lc[p] += lc[i]
        lt[p] += lt[i]
    return tree


def select(tree: Tree) -> tuple[list[float], int, float, list[int]]:
    """(density of each node, root of the body's subtree, threshold, mark of each node)."""
    n = len(tree.parent)
    dense = [composite(tree.c[i], tree.t[i], tree.lc[i], tree.lt[i], tree.c[0], tree.lc[0]) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        sums[tree.parent[i]] += dense[i]
    if n == 1:
        return dense, 0, 0.0, [DENSE]
    best = max(range(1, n), key=lambda i: (sums[i], -i))  # the page as a whole is no subtree of it

    def up(i: int) -> list[int]:
        out = [i]
        while tree.parent[out[-1]] >= 0:
            out.append(tree.parent[out[-1]])
        return out

    path = up(best)
    if tree.title > 0:
        above = up(tree.title)
        if best not in above:
            on_path = set(path)
            best = [i for i in above if i not in on_path][-1]
            path = up(best)
    threshold = min(dense[i] for i in path)
    own = tree.c[best] - tree.lc[best]
    if own < LEAST or 2 * own < tree.c[0] - tree.lc[0]:
        return dense, best, threshold, [DENSE] * n
    on_path = set(path[1:])
    marks, beside = [THIN] * n, []
    for i in range(n):
        p = tree.parent[i]
        if i == best:
            marks[i] = INSIDE
        elif i in on_path:
            marks[i] = DENSE  # text beside the containers
        elif p in on_path:
            marks[i] = DENSE if dense[i] >= threshold else THIN
            beside.append(i)
        else:
            continue
    sign = lambda i: (tree.tag[i], " ".join(tree.sign[i].split()))
    thin = {sign(i) for i in beside if marks[i] == THIN and tree.c[i]}
    root = sign(best)
    if root not in thin:  # dense containers written as the subtree's root continue it, unless thin ones are written so too
        for i in beside:
            if marks[i] == DENSE and sign(i) == root:
                marks[i] = INSIDE
    for i in range(1, n):
        p = tree.parent[i]
        if i != best and i not in on_path and p not in on_path:
            marks[i] = marks[p]
    return dense, best, threshold, marks


def html_marks(text: str | None) -> bytes:
    """The pieces of an html's text with their marks, 8 bytes each: the key with the mark in its two lowest bits.

    Empty for null and blank texts. Of a text that occurs twice the higher mark counts.
    """
    if not text or not text.strip():
        return b""
    tree = html_tree(text)
    marks = select(tree)[3]
    out: dict[int, int] = {}
    for node, key in tree.pieces:
        key &= ~3
        out[key] = max(marks[node], out.get(key, THIN))
    return array("q", [k | m for k, m in out.items()]).tobytes()


def read_marks(data: bytes | None) -> dict[int, int]:
    """key -> mark."""
    pieces = array("q")
    pieces.frombytes(data or b"")
    return {x & ~3: x & 3 for x in pieces}


def mark_of(text: str, marks: dict[int, int]) -> int | None:
    key = text_key(text)
    return marks.get(key & ~3) if key else None
