"""A page's html as a skeleton (its markup without text) and as markdown, in one pass over Arrow batches.

The parser is the tolerant one of `dom`: void elements close at once, an end tag closes up to the nearest open element of its
name, no end tag is implied. Selectors are a tag, .class or #id. Defined results: a null html gives nulls, an empty one ''; whatever
is left out goes with all that stands inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from .dom import VOID

# Elements that are never content, those that stand around the main content, and those without a place in a skeleton. Fixed values.
ALWAYS = ("script", "style", "noscript", "meta", "link", "head")
AROUND = (
    "nav", "header", "footer",
    ".header", ".top", ".navbar", "#header",
    ".footer", ".bottom", "#footer",
    ".menu", ".navigation", "#nav",
    ".breadcrumbs", "#breadcrumbs",
    ".sidebar", ".side", ".aside", "#sidebar",
    "aside",
    ".ad", ".ads", ".advert", "#ad",
    ".advertisement",
    ".modal", ".popup", "#modal", ".overlay",
    ".social", ".social-media", ".social-links", "#social",
    ".share", "#share",
    ".widget", "#widget",
    ".cookie", "#cookie",
    ".lang-selector", ".language", "#language-selector",
)
UNSEEN = ("script", "style", "noscript", "svg")
SKIP = re.compile(r"^\s*skip\s+to\s+(?:main\s+)?content\s*$", re.I)
STAYS = re.compile(r"^(?:data:|javascript:|mailto:|tel:|#)", re.I)
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html main nav ol p pre section summary table ul".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def matches(n: Node, selector: str) -> bool:
    if selector.startswith("."):
        return selector[1:] in n.attrs.get("class", "").split()
    if selector.startswith("#"):
        return n.attrs.get("id") == selector[1:]
    return n.tag == selector


def walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node))


def without(root: Node, selectors: Sequence[str]) -> Node:
    """Takes out all elements that match a selector."""
    for n in walk(root):
        if any(isinstance(c, Node) for c in n.children):
            n.children = [c for c in n.children if isinstance(c, str) or not any(matches(c, s) for s in selectors)]
    return root


def only(root: Node, selectors: Sequence[str]) -> Node:
    """A tree of the elements that match, in the order of the selectors."""
    out = Node("", {})
    for s in selectors:
        out.children.extend(n for n in walk(root) if n is not root and matches(n, s))
    return out


def text_of(n: Node) -> str:
    parts, todo = [], [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            todo.extend(reversed(x.children))
    return "".join(parts)


def skeleton(html: str | None) -> str | None:
    """The markup without scripts, styles and pictures' innards; every text that isn't blank is left out."""
    if html is None:
        return None
    out: list[str] = []
    todo: list[Node | str] = [without(tree(html), UNSEEN)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x if not x.strip() or x.startswith("</") else "")
            continue
        if x.tag:
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items())
            out.append(f"<{x.tag}{attrs}>")
            if x.tag not in VOID:
                todo.append(f"</{x.tag}>")
        todo.extend(reversed([c if isinstance(c, Node) or not c.strip() else "" for c in x.children]))
    return "".join(out)


def best_source(attrs: dict[str, str]) -> str:
    """The source of the largest descriptor of a srcset; where all are densities, the plain source counts as 1x."""
    found: list[tuple[float, str, str]] = []
    for part in attrs.get("srcset", "").split(","):
        bits = part.split()
        if bits:
            m = re.fullmatch(r"(\d+(?:\.\d+)?)([wx])", bits[1]) if len(bits) > 1 else None
            found.append((float(m[1]), m[2], bits[0]) if m else (1.0, "x", bits[0]))
    src = attrs.get("src", "")
    if found and src and all(unit == "x" for _, unit, _ in found):
        found.append((1.0, "x", src))
    return max(found, key=lambda x: x[0])[2] if found else src


def absolute(ref: str, base: str) -> str:
    ref = ref.strip()
    if not ref or not base or STAYS.match(ref):
        return ref
    try:
        return urljoin(base, ref)
    except ValueError:
        return ref


class _Writer:
    """Markdown in document order; blocks are flushed as they end, and nothing recurses."""

    def __init__(self, base: str) -> None:
        self.base = base
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.prefix = ""
        self.lists: list[list] = []  # [tag, number]
        self.quote = self.pre = 0
        self.opened = True  # a list that has no item yet
        self.table: list[list[str]] | None = None

    def flush(self, tight: bool = False) -> None:
        raw = "".join(self.line)
        self.line = []
        s = raw.strip("\n") if self.pre else re.sub(r"[ \t\r\n]+", " ", raw).strip()
        if not s:
            return
        mark, self.prefix = self.prefix, ""
        s = ("> " * self.quote) + mark + s
        if tight and not self.opened and self.blocks and self.lists and re.match(r"(?:> )*\s*(?:- |\d+\. )", self.blocks[-1].rsplit("\n", 1)[-1]):
            self.blocks[-1] += "\n" + s
        else:
            self.blocks.append(s)
        self.opened = not self.lists

    def start(self, n: Node) -> None:
        t = n.tag
        if self.table is not None and t not in ("a", "img", "b", "strong", "i", "em", "code"):
            if t == "tr":
                self.table.append([])
            elif t in ("td", "th"):
                self.line = []
            elif t == "br":
                self.line.append("<br>")
            return
        if t == "li":
            self.flush(True)
            depth = max(0, len(self.lists) - 1)
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                self.prefix = "  " * depth + f"{self.lists[-1][1]}. "
            else:
                self.prefix = "  " * depth + "- "
        elif t in ("ul", "ol"):
            self.flush(True)
            self.opened = self.opened or not self.lists
            self.lists.append([t, 0])
        elif t in BLOCKS:
            self.flush()
        if t[:1] == "h" and t[1:].isdigit() and len(t) == 2:
            self.prefix = "#" * int(t[1]) + " "
        elif t == "hr":
            self.blocks.append("---")
        elif t == "br":
            self.line.append("\n" if self.pre else "  \n")
        elif t == "blockquote":
            self.quote += 1
        elif t == "pre":
            self.pre += 1
        elif t == "table":
            self.table = []
        elif t == "a":
            self.line.append("[")
        elif t == "img":
            self.line.append(f"![{n.attrs.get('alt', '')}]({absolute(best_source(n.attrs), self.base)})")
        elif t in ("b", "strong"):
            self.line.append("**")
        elif t in ("i", "em"):
            self.line.append("_")
        elif t == "code" and not self.pre:
            self.line.append("`")

    def end(self, n: Node) -> None:
        t = n.tag
        if t == "a":
            at = len(self.line) - 1 - self.line[::-1].index("[") if "[" in self.line else -1
            if at >= 0:
                label = re.sub(r"\s*\n\s*", " ", "".join(self.line[at + 1 :])).strip()
                href = n.attrs.get("href")
                self.line[at:] = [f"[{label}]({absolute(href, self.base)})" if href is not None else label]
        elif t in ("b", "strong"):
            self.line.append("**")
        elif t in ("i", "em"):
            self.line.append("_")
        elif t == "code" and not self.pre:
            self.line.append("`")
        elif self.table is not None and t in ("td", "th"):
            cell = re.sub(r"\s+", " ", "".join(self.line)).strip().replace("|", "\\|")
            self.line = []
            if not self.table:
                self.table.append([])
            self.table[-1].append(cell)
        elif t == "table" and self.table is not None:
            rows, self.table, self.line = [r for r in self.table if r], None, []
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                self.blocks.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        elif self.table is not None:
            return
        elif t == "pre":
            code = "".join(self.line).strip("\n")
            self.line = []
            self.pre -= 1
            if code:
                self.blocks.append(f"```\n{code}\n```")
        elif t == "li":
            self.flush(True)
            self.prefix = ""
        elif t in ("ul", "ol"):
            self.flush(True)
            if self.lists:
                self.lists.pop()
        elif t in BLOCKS:
            self.flush()
            self.prefix = ""
            if t == "blockquote":
                self.quote -= 1


def markdown(html: str | None, url: str | None = None, main_only: bool = True, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> str | None:
    """The page as markdown with absolute addresses.

    include keeps only what matches, in the order of the selectors; main_only takes out what stands around the main content; exclude
    takes out more. Links that skip to the content are left out, tables are written with a header line, code in fences.
    """
    if html is None:
        return None
    root = tree(html)
    base = next((n.attrs["href"] for n in walk(root) if n.tag == "base" and n.attrs.get("href")), None)
    base = urljoin(url or "", base) if base else url or ""
    if include:
        root = only(root, include)
    without(root, [*ALWAYS, *(AROUND if main_only else ()), *exclude])
    w = _Writer(base)
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if w.table is None or x.strip():
                w.line.append(x)
        elif isinstance(x, tuple):
            w.end(x[0])
        elif x.tag == "a" and SKIP.match(text_of(x)):
            continue
        else:
            if x.tag:
                w.start(x)
                if x.tag not in VOID:
                    todo.append((x,))
            todo.extend(reversed(x.children))
    w.flush()
    text = "\n\n".join(w.blocks)
    text = "\n".join(line.rstrip() for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def split_pages(df: DataFrame, id_col: str, html_col: str, url_col: str, main_only: bool = True, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """(id, skeleton, markdown) of each html; map-only."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                html, url = b.column(1).to_pylist(), b.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([skeleton(h) for h in html], pa.string()), pa.array([markdown(h, u, main_only, include, exclude) for h, u in zip(html, url)], pa.string())], [id_col, "skeleton", "markdown"])

    return df.select(id_col, html_col, url_col).mapInArrow(run, f"`{id_col}` {id_type}, skeleton string, markdown string")
