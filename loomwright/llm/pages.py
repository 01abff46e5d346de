"""Main content, keyword spam and residue of pages.

Common to all three: a page has a markdown text and an html text, either of which may be null; the markdown decides
where it isn't null, else the html. The html's node tree says where each piece of text stands (`density`): its marks, a few
hundred bytes a page, are joined to the markdown by run_id. The html itself moves only for runs whose markdown is null.

Defined results: pages whose both texts are null, empty or blank, or have no body, are no cases and have no body
blocks; repeated rows of a run_id give the run once (in page_blocks and body_blocks each row's blocks); rows without an id
are left out; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks as B, clauses as C, residue as R
from .components import components
from .density import html_marks
from ..session import cut, written

# The least product of (1 - share of clauses) and coverage at which a body is spam, the share of clauses below which
# it can be, and the characters from which there is enough to tell.
SPAM_SCORE, SPAM_CLAUSES, SPAM_CHARS = 0.3, 0.5, 150
OWN_TEXT = 250  # characters of clauses that make a full text of a page's own


def _map(df: DataFrame, id_col: str, cols: Sequence[str], f: Callable[..., Iterator[tuple]], out: Sequence[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Rows (id, *tuple) for each tuple that f gives for the columns of a row."""
    id_type = df.schema[id_col].dataType.simpleString()
    names = [n for n, _, _ in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                take: list[int] = []
                rows: list[tuple] = []
                for i, args in enumerate(zip(*(batch.column(k + 1).to_pylist() for k in range(len(cols))))):
                    for row in f(*args):
                        take.append(i)
                        rows.append(row)
                parts = list(zip(*rows)) if rows else [[] for _ in out]
                arrays = [pa.array(p, t) for p, (_, t, _) in zip(parts, out)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *arrays], [id_col, *names])

    return df.filter(F.col(id_col).isNotNull()).select(id_col, *cols).mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(f"{n} {t}" for n, _, t in out))


MARKS = [("marks", pa.binary(), "binary")]
MOST_IDS = 1_000_000  # ids of pages without a markdown up to which they are broadcast; beyond it both sides are shuffled


def page_marks(runs: DataFrame, id_col: str = "run_id") -> DataFrame:
    """(id, marks): where each piece of an html's text stands by its density (see `density`), about 8 bytes a piece; one row for each id.

    Only these leave the html's stage, not the html.
    """

    def f(text: str | None) -> Iterator[tuple]:
        data = html_marks(text)
        if data:
            yield (data,)

    return _map(runs.filter(F.col("html").isNotNull()), id_col, ["html"], f, MARKS).groupBy(id_col).agg(F.max("marks").alias("marks"))


def with_marks(splits: DataFrame, runs: DataFrame, id_col: str = "run_id") -> DataFrame:
    """The pages that have a markdown (id, markdown, url) with the marks of their html, null where there is none."""
    md = splits.filter(F.col("markdown").isNotNull() & F.col(id_col).isNotNull()).select(id_col, "markdown", "url")
    # the marks grow with the pages: both sides meet by id, none is broadcast
    return md.join(page_marks(runs, id_col).hint("merge"), id_col, "left")


def html_only(splits: DataFrame, runs: DataFrame, id_col: str = "run_id") -> DataFrame:
    """(id, html, url) of the runs whose markdown is null or absent.

    The anti join compares ids only; the html is then fetched for the ids that are left (a few per cent), by broadcast
    where they are counted to be few enough, else by a join.
    """
    has = splits.filter(F.col("markdown").isNotNull()).select(id_col)
    with_html = runs.filter(F.col("html").isNotNull() & F.col(id_col).isNotNull())
    ids = written(with_html.select(id_col).join(has, id_col, "left_anti").distinct(), "html_only")
    few = ids.count() <= MOST_IDS
    return with_html.select(id_col, "html", "url").join(F.broadcast(ids) if few else ids, id_col, "left_semi")


def html_bodies(splits: DataFrame, runs: DataFrame, f: Callable[[list[B.Block]], Iterator[tuple]], out: Sequence[tuple[str, pa.DataType, str]], id_col: str = "run_id") -> DataFrame:
    """f(blocks of the body) of every page whose markdown is null, of its html."""

    def html(text: str, url: str | None) -> Iterator[tuple]:
        return f(B.body_blocks(B.html_markdown(text), url, html_marks(text)))

    return _map(html_only(splits, runs, id_col), id_col, ["html", "url"], html, out)


def each_body(splits: DataFrame, runs: DataFrame, f: Callable[[list[B.Block]], Iterator[tuple]], out: Sequence[tuple[str, pa.DataType, str]], id_col: str = "run_id") -> DataFrame:
    """f(blocks of the body) of every page: of its markdown, or of its html where that is null."""

    def md(text: str, url: str | None, marks: bytes | None) -> Iterator[tuple]:
        return f(B.body_blocks(text, url, marks))

    return _map(with_marks(splits, runs, id_col), id_col, ["markdown", "url", "marks"], md, out).unionByName(html_bodies(splits, runs, f, out, id_col))


# ------------------------------------------------------------------------------------------- main content

BLOCKS = [("block_no", pa.int32(), "int"), ("kind", pa.string(), "string"), ("text", pa.string(), "string"), ("density", pa.float64(), "double"), ("body", pa.bool_(), "boolean")]


def page_blocks(splits: DataFrame, runs: DataFrame, id_col: str = "run_id") -> DataFrame:
    """(id, block_no, kind, text, density, body) of every block of the markdown; density is the block's own."""

    def f(text: str, url: str | None, marks: bytes | None) -> Iterator[tuple]:
        for b in B.mark_body(B.parse(text, url), url, marks):
            yield b.no, b.kind, b.text, b.density, b.body

    return _map(with_marks(splits, runs, id_col), id_col, ["markdown", "url", "marks"], f, BLOCKS)


def body_blocks(splits: DataFrame, runs: DataFrame, id_col: str = "run_id") -> DataFrame:
    """(id, block_no) of the blocks of each page's own body."""

    def f(text: str, url: str | None, marks: bytes | None) -> Iterator[tuple]:
        for b in B.body_blocks(text, url, marks):
            yield (b.no,)

    return _map(with_marks(splits, runs, id_col), id_col, ["markdown", "url", "marks"], f, BLOCKS[:1])


def main_text(splits: DataFrame, runs: DataFrame, id_col: str = "run_id") -> DataFrame:
    """(id, body_text): the body's blocks of each page, from its markdown or else its html."""

    def f(body: list[B.Block]) -> Iterator[tuple]:
        yield ("\n\n".join(b.text for b in body),)

    return each_body(splits, runs, f, [("body_text", pa.string(), "string")], id_col)


# ------------------------------------------------------------------------------------------- spam

SPAM = [("clause_share", pa.float64(), "double"), ("repeat_share", pa.float64(), "double"), ("link_share", pa.float64(), "double"), ("n_chars", pa.int64(), "bigint"), ("is_spam", pa.bool_(), "boolean")]


def spam_of(blocks: list[B.Block]) -> tuple[float, float, float, int, bool]:
    clause, repeat, link, n = C.spam_features(blocks)
    found = n >= SPAM_CHARS and clause < SPAM_CLAUSES and (1 - clause) * max(repeat, link) >= SPAM_SCORE
    return clause, repeat, link, n, found


def is_spam(blocks: list[B.Block], clauses: tuple[int, int] | None = None) -> bool:
    """The same decision; the automaton is built only where the clauses (their characters and all, if they are counted already) leave it open."""
    inside, total = clauses or C.clause_chars(blocks)
    return total >= SPAM_CHARS and inside < SPAM_CLAUSES * total and spam_of(blocks)[4]


def keyword_spam(splits: DataFrame, runs: DataFrame, id_col: str = "run_id") -> DataFrame:
    """(id, clause_share, repeat_share, link_share, n_chars, is_spam) of each page's body.

    The body's suffix automaton gives the share of characters in repeated maximal substrings, bare links and tags
    count likewise; spam is what has either without clauses. No list of cues takes part: a page without clauses whose text
    doesn't repeat (an error message, a glossary) isn't spam.
    """

    def f(body: list[B.Block]) -> Iterator[tuple]:
        yield spam_of(body)

    return each_body(splits, runs, f, SPAM, id_col).dropDuplicates([id_col])


# ------------------------------------------------------------------------------------------- residue

FEATURES = [
    ("trusted", pa.bool_(), "boolean"),
    ("segs", pa.list_(pa.struct([("g", pa.int64()), ("simhash", pa.int64()), ("shingles", pa.list_(pa.int64()))])), "array<struct<g:bigint,simhash:bigint,shingles:array<bigint>>>"),
]
LEAST_SEGMENT = 8  # letters of a segment that can link
WORDS = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
SEGMENT_END = re.compile(r"(?<=[.!?。！？])\s*|\n")
SHINGLE, SIMILAR, HAMMING, BANDS = 5, 0.8, 3, 4


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(words: list[str]) -> set[int]:
    """Hashes of the runs of five words; of a shorter text the whole is one."""
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    return {xxhash.xxh3_64_intdigest(" ".join(words[i : i + SHINGLE]).encode("utf-8", "surrogatepass")) for i in range(n)}


def simhash(features: list[int]) -> int:
    """64 bits, each the sign of the features' votes."""
    votes = [0] * 64
    for h in features:
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def segments_of(blocks: list[B.Block]) -> dict[str, list[str]]:
    """The sentences and lines of a body as their words, by their text; words with digits and placeholders are left out."""
    out = {}
    for b in blocks:
        if b.kind not in ("image", "rule"):
            for s in SEGMENT_END.split(C.PLACEHOLDER.sub(" ", b.plain)):
                words = [w for w in WORDS.findall(s.lower()) if not any(c.isdigit() for c in w)]
                if sum(map(len, words)) >= LEAST_SEGMENT:
                    out[" ".join(words)] = words
    return out


def can_be_residue(body: list[B.Block]) -> Iterator[tuple]:
    """(trusted, segs) of a body that can be residue; nothing for one with a full text of its own and spam, which by definition are none."""

    def h64(x: str) -> int:
        return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))

    if not body or (clauses := C.clause_chars(body))[0] >= OWN_TEXT or is_spam(body, clauses):
        return
    segs = []
    for text, words in sorted(segments_of(body).items()):
        shingles = shingle_hashes(words)
        # words and shingles vote together, so that one changed word moves few bits
        segs.append({"g": _signed(h64(text)), "simhash": _signed(simhash([*map(h64, words), *shingles])), "shingles": sorted(map(_signed, shingles))})
    yield R.is_residue(body, OWN_TEXT), segs


def residue_features(splits: DataFrame, runs: DataFrame, id_col: str = "run_id") -> DataFrame:
    """(id, trusted, segs) of the pages that can be residue, see `can_be_residue`."""
    return each_body(splits, runs, can_be_residue, FEATURES, id_col)


def near_pairs(reps: DataFrame) -> DataFrame:
    """(a, b): pairs of different texts within HAMMING bits of SimHash whose shingles are SIMILAR or more.

    Four tables of 16 bits hold every pair within three bits at least once. In each table the texts are keyed again by
    four parts of their other 48 bits, of which one must agree as well, so no pair within three bits is lost and buckets
    have 28 bits. Short texts that are SIMILAR are mostly further apart; similar_pairs has those.
    """
    h = F.col("simhash")
    keys = []
    for k in range(BANDS):
        # the hash rotated so that the table's own 16 bits come last
        turned = F.shiftrightunsigned(h, 16 * k).bitwiseOR(F.shiftleft(h, 64 - 16 * k)) if k else h
        own, rest = turned.bitwiseAND(0xFFFF), F.shiftrightunsigned(turned, 16)
        keys += [F.struct(F.lit(4 * k + j).alias("t"), F.shiftleft(own, 12).bitwiseOR(F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)).cast("int").alias("v")) for j in range(4)]
    keyed = reps.select("rep", "simhash", F.explode(F.array(*keys)).alias("x")).select("rep", "simhash", "x.t", "x.v")
    a, b = (keyed.select(F.col("rep").alias(x), F.col("simhash").alias(f"h{x}"), "t", "v") for x in ("a", "b"))
    near = a.join(b, ["t", "v"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= HAMMING)).select("a", "b").distinct()
    return _similar(near, reps)


def _similar(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs whose shingles are SIMILAR or more."""
    s = reps.select("rep", "shingles")
    full = pairs.join(s.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(s.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return full.filter(both >= SIMILAR * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def similar_pairs(reps: DataFrame) -> DataFrame:
    """(a, b): all pairs of different texts whose shingles are SIMILAR or more, by an exact prefix join.

    The shingles of each text are ordered by the number of texts that have them, rare ones first. Of two texts of n
    and m shingles that are SIMILAR, the first n - ceil(SIMILAR * n) + 1 and m - ceil(SIMILAR * m) + 1 have at least one
    in common, so only those are joined; texts of too different lengths are dropped, the rest is compared in full.
    """
    one = reps.select("rep", F.explode("shingles").alias("g"))
    often = one.groupBy("g").agg(F.count("*").alias("n_texts"))
    ordered = one.join(often, "g").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n_texts", "g"))).alias("o"))
    n = F.size("o")
    # the small number only lengthens the prefix where the product is a whole number
    first = (n - F.ceil(F.lit(SIMILAR) * n - F.lit(1e-9)) + 1).cast("int")
    keyed = ordered.select("rep", n.alias("n"), F.explode(F.slice("o", F.lit(1), first)).alias("x")).filter("x.n_texts > 1").select("rep", "n", "x.g")
    a, b = (keyed.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), "g") for k in ("a", "b"))
    pairs = a.join(b, "g").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(SIMILAR) * F.greatest("na", "nb") - F.lit(1e-9)))
    return _similar(pairs.select("a", "b").distinct(), reps)


def residue_pages(splits: DataFrame, runs: DataFrame, id_col: str = "run_id", salts: int = 16) -> DataFrame:
    """(id, trusted): pages whose body is residue.

    Trusted are pages whose body is for a third or more residue by its form (see `residue`: placeholders, filler Latin, traces,
    error codes). Their label is carried over links: pages without a full text of their own are cut into sentences and lines;
    the sentences of a page are linked with each other, equal sentences are one node, and near ones are linked where their
    shingles are SIMILAR (found by SimHash tables, and by the exact prefix join what those miss). Every page in a
    component with a trusted page is residue, in whatever words.

    Scale: texts are collapsed into classes of equal sentences first; a page's links form a star around its first
    sentence, so their number is that of the sentences.
    """
    return linked_residue(residue_features(splits, runs, id_col), id_col, salts)


def linked_residue(features: DataFrame, id_col: str = "run_id", salts: int = 16) -> DataFrame:
    """The same from the pages' features (see `can_be_residue`)."""
    feats = cut(features.dropDuplicates([id_col]).withColumn("gs", F.array_sort(F.transform("segs", lambda x: x["g"]))))
    keyed = feats.withColumn("k1", F.xxhash64("gs")).withColumn("k2", F.xxhash64(F.lit(7), "gs"))
    # pages without a sentence are classes of their own
    keyed = keyed.withColumn("k2", F.when(F.size("gs") > 0, F.col("k2")).otherwise(F.xxhash64(id_col)))
    classes = cut(keyed.groupBy("k1", "k2").agg(F.max("trusted").alias("seed"), F.first("gs").alias("gs"), F.first("segs").alias("segs")))
    reps = cut(classes.select(F.explode("segs").alias("s")).select(F.col("s.g").alias("rep"), F.col("s.simhash").alias("simhash"), F.col("s.shingles").alias("shingles")).dropDuplicates(["rep"]))
    star = classes.select(F.get("gs", F.lit(0)).alias("a"), F.explode(F.expr("slice(gs, 2, greatest(size(gs) - 1, 0))")).alias("b"))
    comp = components(star.unionByName(near_pairs(reps)).unionByName(similar_pairs(reps)), "a", "b")
    first = F.get("gs", F.lit(0))
    label = classes.select("k1", "k2", "seed", first.alias("node")).join(comp, "node", "left").select("k1", "k2", "seed", F.coalesce("component", "node").alias("component"))
    marked = label.filter("seed and component is not null").select("component").distinct()
    found = label.join(marked, "component", "left_semi").select("k1", "k2").unionByName(label.filter("seed and component is null").select("k1", "k2"))
    # one text may stand on a third of all pages: its rows spread over the salts
    found = found.select("k1", "k2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pages = keyed.select(id_col, "trusted", "k1", "k2", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("salt"))
    return pages.join(found, ["k1", "k2", "salt"], "left_semi").select(id_col, "trusted")
