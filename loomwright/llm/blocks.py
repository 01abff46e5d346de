"""Page blocks: cutting markdown or html into blocks and telling the body from the furniture.

The body is selected by composite text density over the page's node tree (see `density`): a block whose text stands inside the
subtree of the largest density sum is body, one in a container below the path's threshold or before the title that stands
in the subtree is not, whatever either says. Links
into the site's own tree are the only thing looked at inside the subtree. Where neither holds, a check of the single block
follows: for dense containers outside the subtree, blocks that aren't in the html, and pages without an html. It goes by
links into the site's own tree, the site's own name and standing cues of consent, sign-up, share, breadcrumb and imprint lines.

Plain Python over whole texts; nothing here knows Spark.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass

from .density import DENSE, INSIDE, THIN, TOKEN, composite, html_marks, mark_of, read_marks

LINE_END = re.compile(r"\r\n|\n|\r")
LINK = re.compile(r"(!?)\[([^\[\]]*)\]\(([^()\s]*)[^()]*\)")
ITEM = re.compile(r"[ \t]*(?:[*+-]|\d{1,4}[.)])[ \t]+")
LEAD = re.compile(r"[\s>#]*(?:[*+-]\s+|\d{1,4}[.)]\s+)?")
RULE = re.compile(r"[ \t]*(?:[-*_][ \t]*){3,}$")
SENTENCE = re.compile(r"[^.!?。！？]*[.!?。！？]+[\"'”»«“)\]]*|[^.!?。！？]+")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
CJK_LEADS = bytes(range(0xE3, 0xEA))  # first bytes of such signs in UTF-8

# Cues by which a reader knows furniture, in the seven languages of the corpus, in lower case. Fixed values.
CONSENT = (
    "cookie", "クッキー", "store small files", "manage preferences", "reject everything",
    "speichern kleine dateien", "einstellungen verwalten", "alles optionale",
    "petits fichiers sur votre", "pequeños archivos en su", "pequenos ficheiros no seu", "принять все файлы",
)
SIGNUP = (
    "newsletter", "mailing list", "unsubscribe", "no spam", "rundbrief", "jederzeit abbestell", "auf die liste zu kommen",
    "inscrivez-vous à notre", "désinscription", "rejoindre la liste", "nuestro boletín", "darse de baja", "entrar en la lista",
    "nosso boletim", "cancelar quando quiser", "entrar na lista", "нашу рассылку", "отписаться", "メールマガジン", "いつでも解除",
)
SHARE = (
    "share on social", "share this page", "print this page", "sozialen netzen", "seite drucken", "teilen sie diese seite",
    "partager sur les réseaux", "partagez cette page", "imprimer la page", "comparta esta página", "compartir en las redes",
    "imprimir esta página", "partilhe esta página", "partilhar nas redes", "поделитесь этой страниц", "поделиться в соц",
    "распечатать страницу", "友だちに共有", "ページを印刷",
)
IMPRINT = (
    "all rights reserved", "written permission of", "terms of use", "errors and omissions", "privacy policy",
    "alle rechte vorbehalten", "nutzungsbedingungen", "irrtum vorbehalten", "tous droits réservés", "mentions légales", "sauf erreur",
    "todos los derechos reservados", "aviso legal", "salvo error", "todos os direitos reservados", "salvo erro",
    "все права защищены", "возможны ошибки", "無断転載", "税込みです",
)
CRUMB = (
    "you are here", "sie sind hier", "vous êtes ici", "está usted aquí", "usted está aquí", "está aqui", "você está aqui",
    "вы здесь", "現在の場所",
)
RELATED = (
    "related articles", "popular right now", "most read this week", "you may also like", "ähnliche beiträge",
    "diese woche am meisten", "das könnte sie auch", "articles liés", "les plus lus", "vous aimerez aussi",
    "artículos relacionados", "lo más leído", "también le puede gustar", "artigos relacionados", "os mais lidos",
    "também pode gostar", "похожие статьи", "самое читаемое", "вам также понравится", "関連記事", "今週よく読まれ", "こちらもおすすめ",
)
CUES = CONSENT + SIGNUP + SHARE + IMPRINT
# Menu words of the seven languages. Fixed values.
MENU = frozenset(
    """shop|gallery|home|news|prices|careers|about us|contact|help|guides|delivery|events calendar|agenda|contacto
    lieferung|boutique|aktuelles|livraison|emploi|conseils|über uns|startseite|actualités|hilfe|galerie|preise
    notícias|bilder|tarifs|ratgeber|aide|kontakt|entregas|laden|quem somos|nous écrire|início|galería|guías|emprego
    termine|контакты|stellen|empleo|preços|ajuda|советы|galeria|precios|главная|ayuda|qui sommes-nous|цены|loja|accueil
    новости|магазин|помощь|галерея|о нас|noticias|quiénes somos|вакансии|inicio|envíos|tienda|guias|доставка|события
    ホーム|採用|お問い合わせ|料金|お店|ヘルプ|配送|写真|会社案内|ガイド|お知らせ|予定""".replace("\n", "|").replace("    ", "").split("|")
)


@dataclass(slots=True)
class Block:
    no: int
    text: str
    lines: list[str]
    kind: str = "p"  # h, list, table, quote, code, image, rule, p
    level: int = 0
    plain: str = ""  # the text without markup and links' addresses
    c: int = 0  # characters that aren't white space, outside markup
    t: int = 1  # tags
    lc: int = 0
    lt: int = 0
    own: int = 0  # link characters into the site's own tree
    density: float = 0.0
    body: bool = True


def split_blocks(text: str | None) -> list[list[str]]:
    """Runs of lines that aren't blank; none for a null, empty or blank text."""
    out: list[list[str]] = []
    cur: list[str] = []
    for line in LINE_END.split(text) if text and "\r" in text else (text or "").split("\n"):
        if line.strip():
            cur.append(line)
        elif cur:
            out.append(cur)
            cur = []
    if cur:
        out.append(cur)
    return out


def site_label(url: str | None) -> str:
    """The first word of the site's own name, as its host has it; '' where no host can be read."""
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower())
    host = re.split(r"[/?#\s]", host, maxsplit=1)[0].rsplit("@", 1)[-1].split(":")[0]
    labels = [x for x in host.split(".") if x]
    if len(labels) > 2 and len(labels[0]) <= 5:
        labels = labels[1:]
    name = labels[0].split("-")[0] if labels else ""
    return name if len(name) >= 4 else ""


def _own(target: str, host: str) -> bool:
    return target[:1] in "/#?" and target[:2] != "//" or target == "" or bool(host) and f"//{host}" in target.lower()


def cjk_chars(text: str) -> int:
    """The number of CJK's signs."""
    if text.isascii():
        return 0
    data = text.encode("utf-8", "surrogatepass")
    return len(CJK.findall(text)) if len(data.translate(None, CJK_LEADS)) < len(data) else 0


def _chars(text: str) -> int:
    return len("".join(text.split()))


def parse(text: str | None, url: str | None = None) -> list[Block]:
    """The blocks of a markdown text with their kinds and counts."""
    out = []
    fence = False
    host = re.split(r"[/?#\s]", re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower()), maxsplit=1)[0]
    for no, lines in enumerate(split_blocks(text)):
        b = Block(no, "\n".join(lines), lines)
        first = lines[0].lstrip()
        ticks = sum(x.lstrip().startswith(("```", "~~~")) for x in lines) if "```" in b.text or "~~~" in b.text else 0
        if fence or ticks:
            b.kind = "code"
            fence = bool(ticks % 2) != fence
        elif first.startswith("#") and re.match(r"#{1,6}(?:\s|$)", first):
            b.kind, b.level = "h", len(first) - len(first.lstrip("#"))
        elif first.startswith("|"):
            b.kind = "table"
        elif first.startswith(">"):
            b.kind = "quote"
        elif RULE.match(lines[0]) and len(lines) == 1:
            b.kind = "rule"
        elif all(ITEM.match(x) for x in lines[:2]):
            b.kind = "list"
        elif all(x[:4] == "    " or x[:1] == "\t" for x in lines):
            b.kind = "code"
        elif first.startswith("![") and LINK.sub("", b.text).strip() == "":
            b.kind = "image"
        b.t = len(lines) if b.kind in ("list", "table", "p") else 1
        plain = b.text
        if "](" in plain:
            for bang, label, target in LINK.findall(plain):
                b.t += 1
                if not bang:
                    n = _chars(label)
                    b.lt += 1
                    b.lc += n
                    if _own(target, host):
                        b.own += max(n, 1)
            plain = LINK.sub(lambda m: m[2], plain)
        if b.kind in ("list", "h", "quote"):
            plain = "\n".join(x[LEAD.match(x).end() :] for x in plain.split("\n"))
        b.plain = plain.strip()
        b.c = _chars(b.plain)
        out.append(b)
    return out


def _totals(blocks: list[Block]) -> tuple[int, int, int, int]:
    c = t = lc = lt = 0
    for b in blocks:
        c += b.c
        t += b.t
        lc += b.lc
        lt += b.lt
    return c, t, lc, lt


def densities(blocks: list[Block]) -> float:
    """Fills in each block's density; the threshold of the path to the section of the largest density sum, over the markdown's own tree."""
    starts = sorted({0, *(i for i, b in enumerate(blocks) if b.kind == "h")})
    spans = [(a, z) for a, z in zip(starts, [*starts[1:], len(blocks)]) if z > a]
    c, t, lc, lt = _totals(blocks)
    for b in blocks:
        b.density = composite(b.c, b.t, b.lc, b.lt, c, lc)
    if not spans:
        return 0.0
    best = max(range(len(spans)), key=lambda i: (sum(b.density for b in blocks[spans[i][0] : spans[i][1]]), -i))
    own = blocks[spans[best][0] : spans[best][1]]
    return min(composite(c, t + len(spans) + 1, lc, lt, c, lc), composite(*_totals(own), c, lc))


MARKED = re.compile(r"[.!?。！？:;,、|{}\[\]<>%$@_=]\s*$|[{}<>=@$]|__|%\w+%")


def _short_lines(b: Block) -> bool:
    """Bare lines without an end of sentence, of a few words each."""
    return b.kind == "p" and all(len(x) <= 60 and len(x.split()) <= 10 and not MARKED.search(x.strip()) for x in b.plain.split("\n"))


def is_teaser(b: Block) -> bool:
    """Lines that open with a link into the site's own tree and go on in running text."""
    return b.kind == "p" and b.own > 0 and all((m := LINK.match(x.strip())) and not m[1] and m[3][:1] == "/" for x in b.lines)


def block_mark(b: Block, marks: dict[int, int]) -> int | None:
    """The mark of a block's text in the html: of the whole, or of the most of its lines and cells; None where most of it isn't there."""
    if b.kind == "image":
        m = LINK.search(b.text)
        return mark_of("img " + m[3], marks) if m else None
    whole = mark_of(b.plain, marks)
    if whole is not None:
        return whole
    got: Counter[int] = Counter()
    missed = 0
    for line in b.plain.split("\n"):
        for part in [line] if (m := mark_of(line, marks)) is not None else line.split("|"):
            m = mark_of(part, marks)
            if m is not None:
                got[m] += len(part)
            else:
                missed += len(part.strip(" -:"))
    return max(got, key=lambda k: (got[k], k)) if got and missed <= 2 * got.total() else None


def _between(blocks: list[Block], found: list[int | None]) -> list[int]:
    """Blocks that aren't in the html stand where their neighbours do; DENSE where those differ, and for links into the site."""
    after: list[int | None] = [None] * len(found)
    for i in range(len(found) - 2, -1, -1):
        after[i] = found[i + 1] if found[i + 1] is not None else after[i + 1]
    before, out = None, []
    for i, m in enumerate(found):
        if m is not None:
            before = m
        out.append(m if m is not None else before if before is not None and before == after[i] and not blocks[i].own else DENSE)
    return out


def mark_body(blocks: list[Block], url: str | None = None, data: bytes | None = None) -> list[Block]:
    """Sets ``body`` of each block; data are the marks of the page's html (see `density.html_marks`), empty without one."""
    marks = read_marks(data)
    found = _between(blocks, [block_mark(b, marks) for b in blocks]) if marks else [DENSE] * len(blocks)
    title = next((i for i, b in enumerate(blocks) if b.kind == "h" and b.level == 1 and found[i] == INSIDE), 0)
    if DENSE in found:
        checked(blocks, url, [m == DENSE and i >= title for i, m in enumerate(found)])
    if not marks:
        return blocks
    for i, (b, m) in enumerate(zip(blocks, found)):
        if m == INSIDE:
            b.body = not own_links(b)
        elif m == THIN or i < title:
            b.body = False
    return blocks


def own_links(b: Block) -> bool:
    """Links into the site's own tree make up most of the block, or it is a teaser behind such a link."""
    return bool(b.lc) and b.own * 2 >= b.lc and (b.own * 2 >= b.c or is_teaser(b))


def checked(blocks: list[Block], url: str | None = None, asked: list[bool] | None = None) -> list[Block]:
    """Sets ``body`` of each block by the check alone; of those that aren't asked for (by default all are) only as far as it decides on later ones."""
    threshold = densities(blocks)
    site = site_label(url)
    title = next((i for i, b in enumerate(blocks) if b.kind == "h" and b.level == 1), -1)
    related = False
    for i, b in enumerate(blocks):
        if b.kind == "h":
            related = b.level > 1 and _has(b.plain.lower(), RELATED)
            b.body = not related
            continue
        if b.kind in ("code", "rule", "quote", "table", "image"):
            related = related and b.kind in ("image", "rule")
            b.body = b.kind == "rule" and not related or b.kind != "rule"
            continue
        if not related and asked and not asked[i]:
            continue  # no list of links is open, and this block opens none
        lines = b.plain.split("\n")
        low = b.plain.lower()
        if own_links(b):
            b.body = False
            related = related and is_teaser(b)
        elif b.own and low.startswith(RELATED):
            b.body = False
        elif site and site in low and b.kind == "p":
            b.body = False  # the site speaks of itself
        elif low.startswith(CRUMB) and len(low) <= 300 or _has(low, CUES) and _cued(low):
            b.body = False
        elif b.c <= 60 * b.t and _short_lines(b) and (related or i < title and len(lines) > 1 and b.density < threshold or sum(x.strip() in MENU for x in low.split("\n")) * 2 > len(lines)):
            b.body = related = False
        elif b.kind == "list" and related and b.c <= 60 * b.t and not re.search(r"[.。]\s*$", b.plain):
            b.body = related = False
        else:
            related = False
            b.body = True
    return blocks


def _has(low: str, cues: tuple[str, ...]) -> bool:
    return any(x in low for x in cues)


def _cued(low: str) -> bool:
    """Whether most of the text stands in sentences with a cue."""
    hit = total = 0
    for s in SENTENCE.findall(low):
        n = _chars(s)
        total += n
        if _has(s, CUES):
            hit += n
    return hit * 2 >= total


def body_blocks(text: str | None, url: str | None = None, data: bytes | None = None) -> list[Block]:
    return [b for b in mark_body(parse(text, url), url, data) if b.body]


# ---------------------------------------------------------------------------------------------- html

BLOCK_TAG = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HREF = re.compile(r"""\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
ALT = re.compile(r"""\balt\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def html_markdown(text: str | None) -> str | None:
    """The page's text as markdown blocks in document order; None for null.

    Lists, tables and pre-formatted text are one block each; links keep their addresses; scripts, styles and the
    head are left out, the text of noscript as well unless nothing else stands in the page.
    """
    if text is None:
        return None
    out: list[list[str]] = []
    line: list[str] = []
    prefix, group, href = "", "", []
    depth = {"list": 0, "table": 0, "pre": 0, "quote": 0}
    ordered: list[bool] = []

    def flush(new_group: bool) -> None:
        nonlocal line, group
        s = "".join(line)
        s = s.strip("\n") if depth["pre"] else " ".join(s.split())
        line = []
        if s:
            mark = prefix
            if depth["quote"]:
                mark = "> " + mark
            s = "\n".join(("    " + x) if depth["pre"] else mark + x for x in s.split("\n") if x.strip())
            if group and out and not new_group:
                out[-1].append(s)
            else:
                out.append([s])
            group = "pre" if depth["pre"] else "list" if depth["list"] else "table" if depth["table"] else ""
        if new_group:
            group = ""

    pos = 0
    for m in TOKEN.finditer(text):
        if m.start() > pos:
            line.append(_html.unescape(text[pos : m.start()]))
        pos = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        closing = m[2] == "/"
        if tag == "a":
            if not closing:
                h = HREF.search(m[4] or "")
                href.append(_html.unescape(h[1].strip("\"'")) if h else "")
                line.append("[")
            elif href:
                line.append(f"]({href.pop().replace(' ', '%20')})")
        elif tag == "br":
            line.append("\n" if depth["pre"] else " ")
        elif tag == "img":
            a = ALT.search(m[4] or "")
            line.append(f"![{_html.unescape(a[1].strip(chr(34) + chr(39))) if a else ''}](img)")
        elif tag in BLOCK_TAG:
            is_list, is_row = tag in ("ul", "ol", "dl"), tag == "tr"
            if tag in ("td", "th") and depth["table"]:
                if closing:
                    line.append(" | ")
                continue
            simple = tag in ("li", "dt", "dd") or is_row or tag in ("tbody", "thead", "tfoot")
            flush(not simple and not (depth["list"] and not is_list) and not (depth["table"] and tag != "table" and not is_list))
            prefix = ""
            step = -1 if closing else 1
            if is_list:
                depth["list"] = max(0, depth["list"] + step)
                ordered.append(tag == "ol") if not closing else (ordered and ordered.pop())
                group = ""
            elif tag == "table":
                depth["table"] = 0  # tables for layout hold blocks; those of data only cells, see below
                if not closing and _data_table(text, m.end()):
                    depth["table"] = 1
                group = ""
            elif tag == "pre":
                depth["pre"] = max(0, depth["pre"] + step)
                group = ""
            elif tag == "blockquote":
                depth["quote"] = max(0, depth["quote"] + step)
            elif not closing and tag in ("li", "dt", "dd"):
                prefix = "1. " if ordered and ordered[-1] else "- "
            elif not closing and is_row and depth["table"]:
                prefix = "| "
            elif not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                prefix = "#" * int(tag[1]) + " "
    if pos < len(text):
        line.append(_html.unescape(text[pos:]))
    flush(True)
    md = "\n\n".join("\n".join(x) for x in out)
    if not md.strip():
        inner = " ".join(re.findall(r"<noscript\b[^>]*>(.*?)(?:</noscript\s*>|$)", text, re.S | re.I))
        md = " ".join(_html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
    return md


def _data_table(text: str, at: int) -> bool:
    end = text.find("</table", at)
    inner = text[at : end if end >= 0 else len(text)].lower()
    return inner.count("<td") + inner.count("<th") > 1 and not re.search(r"<(?:p|div|h[1-6]|ul|ol|table)\b", inner)


def page_text(markdown: str | None, html: str | None) -> str | None:
    """The markdown, or the html's where that is null."""
    return markdown if markdown is not None else html_markdown(html)
