"""Languages of documents and of their blocks, by error-correcting output codes.

Each language has a codeword of 15 bits; any two differ in 8. For each bit one linear classifier over hashed
character n-grams (1 to 4) predicts it. The classifiers' outputs are decoded by loss: the language whose codeword
has the least sum of logistic losses, weighted by how well each bit is predicted, wins; the margin to the second
gives the confidence, and a small margin flags the block as ambiguous.

Training: a first model is fitted on a bounded number of labelled rows (parameter `sample`, 1,200 by default, the smallest hashes of their
ids), whose labels may partly be wrong, and a few built-in words of each language, so that no language is without a row; one pass over
all labelled blocks trains it further (see `train_further`).
Prediction covers all rows in one map-only pass: the n-grams of about 100 texts are hashed at once.

Defined results: null, empty and blank texts and texts without letters have no language; labels are read in any usual
notation (see `canonical_label`), all others are unknown; a page without a label counts as labelled with null;
rows without an id are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks as B, clauses as C
from .pages import FEATURES, OWN_TEXT, SPAM_CLAUSES, _map, can_be_residue, html_bodies, is_spam, linked_residue, with_marks
from ..session import written

LANGUAGES = ("en", "de", "es", "fr", "pt", "ru", "ja")
# Names and three-letter codes of the languages. Fixed values.
NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "es": "es spa spanish español castellano castilian", "fr": "fr fra fre french français",
    "pt": "pt por portuguese português", "ru": "ru rus russian русский", "ja": "ja jpn japanese 日本語",
}
# Frequent words, as further rows of the training. Fixed values.
SEEDS = {
    "en": "the and of to in that with for this from are was were which their would have been there when what some because about after",
    "de": "der die das und nicht mit eine einen einer für auf werden auch sich sind wurde noch über durch weil oder wenn nach während",
    "es": "el los las una del con para pero porque como más este esta ha según donde también hasta desde mientras sobre muy cada años",
    "fr": "le les des une dans pour avec est sont pas plus mais cette aux leur nous vous très être après depuis chaque où même",
    "pt": "os as uma não com para mas porque como mais este esta foi são ao pelo até também enquanto muito cada está depois sobre",
    "ru": "и в не на что он как это все она так его но они было мы вы только уже для если когда чтобы после более каждый",
    "ja": "これ それ です ます した して いる ある こと ため から まで など として という では ません でした について によって",
}
BUCKETS, BITS = 1 << 13, 15
LETTERS = re.compile(r"[^\W\d_]+")
ASCII = "".join(chr(i).lower() if LETTERS.match(chr(i)) else " " for i in range(128))  # the same for texts of ASCII, in lower case


def codewords() -> np.ndarray:
    """Rows of the Hadamard matrix of order 16 without its first column: any two differ in 8 of 15 bits."""
    h = np.array([[1]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    return h[1 : len(LANGUAGES) + 1, 1:].astype(np.float32)


def canonical_label(label: str | None) -> str | None:
    """The language a label names in a usual notation: code, code with region, three-letter code, name; any case."""
    if not label:
        return None
    first = re.split(r"[-_\s(]", label.strip().lower(), maxsplit=1)[0]
    return next((k for k, v in NAMES.items() if first in v.split()), None)


def canonical_column(label: Column) -> Column:
    """The same as an expression."""
    first = F.element_at(F.split(F.lower(F.trim(label)), r"[-_\s(]", 2), 1)
    out = F.lit(None).cast("string")
    for k, v in NAMES.items():
        out = F.when(first.isin(v.split()), F.lit(k)).otherwise(out)
    return F.when(label.isNull(), F.lit(None).cast("string")).otherwise(out)


def clean(text: str) -> str:
    """Lower-case letters; everything else is one blank. Links and their addresses, names in quotes stay out."""
    if "](" in text:
        text = B.LINK.sub(" ", text)
    return " ".join(text.translate(ASCII).split() if text.isascii() else LETTERS.findall(text)).lower()


def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts, the text of each, number of each text)."""
    # four blanks between texts: no n-gram reaches into the next one
    code = np.frombuffer((" " + "    ".join(texts) + "        ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 4)
    n = int(ends[-1]) if len(texts) else 0
    inside = np.ones(n, bool)
    for k in (1, 2, 3):
        inside[ends - k] = False
    inside = np.flatnonzero(inside)
    out = np.empty((4, len(inside)), np.int64)
    h, m = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    for k in range(4):
        h *= np.uint64(0x100000001B3)
        h += code[k : k + n]
        h += np.uint64(k + 1)
        np.right_shift(h, np.uint64(31), out=m)
        m ^= h
        m *= np.uint64(0x9E3779B97F4A7C15)
        m >>= np.uint64(51)
        np.take(m.view(np.int64), inside, out=out[k], mode="clip")
    return out, np.repeat(np.arange(len(texts)), lengths + 1), lengths


SOME = 64  # texts whose n-grams are counted at once


def counts(texts: Sequence[str], into: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams' counts, one row for each text, and the rows' lengths; in the first rows of `into`, where that is given."""
    x = np.empty((len(texts), BUCKETS), np.float32) if into is None else into[: len(texts)]
    norms = np.empty((len(texts), 1), np.float32)
    for a in range(0, len(texts), SOME):
        some = x[a : a + SOME]
        g, owner, _ = grams(texts[a : a + SOME])
        g += owner * BUCKETS
        if g.size < 1 << 24:  # up to there, counts of 32 bits are exact
            some.fill(0)
            np.add.at(some.reshape(-1), g.ravel(), np.float32(1))
        else:
            some[:] = np.bincount(g.ravel(), minlength=some.size).reshape(some.shape)
        norms[a : a + SOME, 0] = np.sqrt(np.einsum("ij,ij->i", some, some))
    return x, np.maximum(norms, np.float32(1e-9))


def features(texts: Sequence[str]) -> np.ndarray:
    """The n-grams' counts of unit length, one row for each text."""
    x, norms = counts(texts)
    x /= norms
    return x


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS x BITS
    bias: np.ndarray
    bit_weight: np.ndarray

    def outputs(self, texts: Sequence[str]) -> np.ndarray:
        """The classifiers' outputs for each text, over its whole length."""
        out = np.zeros((len(texts), BITS), np.float32)
        x = np.empty((min(SOME, len(texts)), BUCKETS), np.float32)
        a = 0
        while a < len(texts):  # about 200,000 signs at once, and at most SOME texts
            z, size = a, 0
            while z < len(texts) and z < a + SOME and (z == a or size + len(texts[z]) < 200_000):
                size += len(texts[z])
                z += 1
            some, norms = counts(texts[a:z], x)
            out[a:z] = some @ self.weights / norms + self.bias
            a = z
        return out

    def decode(self, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, confidence, whether the second is close) of each row of outputs."""
        code = codewords()
        loss = np.stack([(np.logaddexp(0, -outputs * c) * self.bit_weight).sum(1) for c in code], 1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        return loss.argmin(1), p.max(1), order[:, -1] - order[:, -2] < 0.4


def _fit(x: np.ndarray, y_lang: np.ndarray, rounds: int, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Logistic regression of every bit at once, by Adam over all rows; languages weigh alike."""
    y = codewords()[y_lang]
    weight = (1.0 / np.bincount(y_lang, minlength=len(LANGUAGES)).clip(1))[y_lang].astype(np.float32)[:, None] / len(LANGUAGES)
    w, b = np.zeros((BUCKETS, BITS), np.float32), np.zeros(BITS, np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, rounds + 1):
        z = x @ w + b
        g = -y / (1 + np.exp((y * z).clip(-30, 30))) * weight
        gw, gb = x.T @ g + decay * w, g.sum(0)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    right = ((x @ w + b) * y > 0).astype(np.float32)
    return Model(w, b, _bit_weight((right * weight).sum(0) / weight.sum()))


def _bit_weight(acc: np.ndarray) -> np.ndarray:
    """The weight of each bit by the share of rows in which it is predicted right."""
    return (np.log((acc + 1e-3) / (1 - acc + 1e-2))).clip(0.1, 5).astype(np.float32) / 5


def train(texts: Sequence[str], labels: Sequence[str]) -> Model:
    """A model of labelled texts of which some labels may be wrong.

    A first, weakly fitted model judges the rows themselves; those it reads as another language than their label are
    left out, and the final model is fitted on the rest. The built-in words stay in.
    """
    texts = [*(clean(t) for t in texts), *SEEDS.values()]
    y = np.array([LANGUAGES.index(v) for v in [*labels, *SEEDS]])
    x = features(texts)
    for rounds in (25, 40):
        rough = _fit(x, y, rounds, rate=0.1, decay=1e-3)
        guess, _, _ = rough.decode(x @ rough.weights + rough.bias)
        keep = (guess == y) | (np.arange(len(y)) >= len(texts) - len(SEEDS))
        x, y = x[keep], y[keep]
        texts = [t for t, k in zip(texts, keep) if k]
    return _fit(x, y, 120)


def running(b: B.Block) -> bool:
    return b.kind in ("p", "quote", "list")


def train_on(df: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = 1200, each: int = 2) -> Model:
    """A model of at most `sample` labelled rows, of each its `each` longest blocks of running text, whole."""
    d = df.select(F.col(text_col).alias("t"), canonical_column(F.col(label_col)).alias("l"), F.xxhash64(id_col).alias("h")).filter("l is not null and length(trim(t)) > 0")
    texts, labels = [], []
    for r in d.orderBy("h").limit(sample).collect():
        found = [b.plain for b in B.parse(r["t"]) if running(b) and any(map(C.is_sentence, C.sentences(b)))]
        found = sorted(found, key=len, reverse=True)[:each]
        texts += found
        labels += [r["l"]] * len(found)
    return train(texts, labels)


def words_of(text: str) -> float:
    """Words of a text; a Japanese sign counts as half a word."""
    if text.isascii() and "'" not in text and "-" not in text:  # each run of letters is a word
        return float(len(text.translate(ASCII).split()))
    cjk = B.cjk_chars(text)
    return cjk / 2 + len(B.WORD.findall(B.CJK.sub(" ", text) if cjk else text))


BATCH = 256  # blocks of one step of the training


def train_further(texts: DataFrame, start: Model, pages: dict[str, int], rate: float = 0.02, decay: float = 1e-4) -> Model:
    """The model after one pass over all labelled blocks (label, text), from a first one.

    Each task goes on from the first model by Adam over its blocks; the tasks' models are averaged by their numbers of blocks, in a tree.
    Blocks that the first model reads as another language than their label are left out, as in `train`. pages: the pages of each
    label, by which languages weigh alike. How well each bit is predicted is counted on blocks before they are trained on.
    """
    shared = texts.sparkSession.sparkContext.broadcast(start)
    alike = np.array([sum(pages.values()) / len(LANGUAGES) / max(1, pages.get(k, 0)) for k in LANGUAGES], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shared.value
        fixed = np.pad(first.weights, ((0, 0), (0, 1)))  # with a column of zeros more: products of 16 columns are faster than of 15
        w, b = fixed.copy(), first.bias.copy()
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
        space = np.empty((BATCH, BUCKETS), np.float32)  # one for all steps
        right, total, n, t = np.zeros(BITS), 0.0, 0, 0
        rest: list[tuple[str, int]] = []

        def step(some: list[tuple[str, int]]) -> None:
            nonlocal w, b, m, v, mb, vb, right, total, n, t
            (x, norms), lang = counts([k for k, _ in some], space), np.array([k for _, k in some])
            keep = first.decode((x @ fixed / norms)[:, :BITS] + first.bias)[0] == lang
            if not keep.any():
                return
            # rows that are left out weigh nothing
            y, weight = codewords()[lang], np.where(keep, alike[lang], np.float32(0))[:, None]
            z = (x @ w / norms)[:, :BITS] + b
            right += ((z * y > 0) * weight).sum(0)
            total += float(weight.sum())
            g = -y / (1 + np.exp((y * z).clip(-30, 30))) * weight / BATCH
            gw, gb = x.T @ (np.pad(g, ((0, 0), (0, 1))) / norms) + decay * w, g.sum(0)
            t += 1
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.99**t
            w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
            n += int(keep.sum())

        for batch in batches:
            rest += zip(batch.column(0).to_pylist(), (LANGUAGES.index(k) for k in batch.column(1).to_pylist()))
            for at in range(0, len(rest) - BATCH + 1, BATCH):
                step(rest[at : at + BATCH])
            rest = rest[len(rest) // BATCH * BATCH :]
        if rest:
            step(rest)
        if n:
            sums = np.concatenate([(w[:, :BITS] * n).ravel(), b * n, right, [total, n]]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    found = texts.select("text", "label").filter("label is not null").mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
    sums = found.treeAggregate(np.zeros(BUCKETS * BITS + 2 * BITS + 2), lambda x, y: x + y, lambda x, y: x + y)
    if not sums[-1]:
        return start
    w, b, right = np.split(sums[:-2], [BUCKETS * BITS, BUCKETS * BITS + BITS])
    return Model((w / sums[-1]).reshape(BUCKETS, BITS).astype(np.float32), (b / sums[-1]).astype(np.float32), _bit_weight(right / sums[-2]))


DOZEN = 12  # words from which a block without a sentence is running text


def read_text(b: B.Block) -> str:
    """What of a block is read: its sentences by form; all of it where it has none and a dozen words."""
    text = "\n".join(s for s in C.sentences(b) if C.is_sentence(s))
    return clean(text or (b.plain if words_of(b.plain) >= DOZEN else ""))


TEXTS = [("block_no", pa.int32(), "int"), ("text", pa.string(), "string"), ("n_words", pa.float64(), "double"), ("n_chars", pa.int64(), "bigint"), ("label", pa.string(), "string"), ("open", pa.bool_(), "boolean"), *FEATURES]


def page_texts(splits: DataFrame, runs: DataFrame, labels: DataFrame, id_col: str = "run_id") -> DataFrame:
    """(id, block_no, text, n_words, n_chars, label, open, trusted, segs) of every block of running text of each body; none of spam.

    Pages that can be residue are open; each has a further row without a block_no, with the features by which that is decided.
    """

    def f(text: str, url: str | None, marks: bytes | None, label: str | None) -> Iterator[tuple]:
        body = B.body_blocks(text, url, marks)
        is_open = not C.mostly_clauses(body, SPAM_CLAUSES, OWN_TEXT)
        if is_open:
            clauses = C.clause_chars(body)
            if is_spam(body, clauses):
                return
            is_open = clauses[0] < OWN_TEXT
        if is_open:
            for features in can_be_residue(body):
                yield None, None, None, None, label, True, *features
        for b in body:
            if running(b) and (plain := read_text(b)):
                yield b.no, plain, words_of(b.plain), b.c, label, is_open, None, None

    # labels are grouped by id as the marks are, so no text moves once more
    return _map(with_marks(splits, runs, id_col).join(labels.hint("merge"), id_col, "left"), id_col, ["markdown", "url", "marks", "label"], f, TEXTS)


SEGMENTS = "block_no int, lang string, confidence double, ambiguous boolean, n_words double, n_chars bigint"


def segments(texts: DataFrame, model: Model, id_col: str) -> DataFrame:
    """(id, block_no, lang, confidence, ambiguous, n_words, n_chars) of each block (see `page_texts`). Map-only; the model (500 KB, whatever the data) travels with the tasks."""
    id_type = texts.schema[id_col].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            best, conf, doubt = model.decode(model.outputs(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([LANGUAGES[k] for k in best], pa.string()),
                    pa.array(conf, pa.float64()), pa.array(doubt, pa.bool_()), batch.column(3), batch.column(4),
                ],
                [id_col, "block_no", "lang", "confidence", "ambiguous", "n_words", "n_chars"],
            )

    return texts.select(id_col, "block_no", "text", "n_words", "n_chars").mapInArrow(run, f"`{id_col}` {id_type}, {SEGMENTS}")


def document_languages(seg: DataFrame, id_col: str) -> DataFrame:
    """(id, lang, confidence, ambiguous, mixed): the language most of each document is written in, by characters.

    A document has few languages, so the second grouping is bounded by their number.
    """
    per = seg.groupBy(id_col, "lang").agg(F.sum("n_chars").alias("n"), (F.sum(F.col("confidence") * F.col("n_chars")) / F.sum("n_chars")).alias("c"))
    return per.groupBy(id_col).agg(
        F.max_by("lang", F.struct("n", "lang")).alias("lang"),
        (F.max("n") / F.sum("n") * F.max_by("c", F.struct("n", "lang"))).alias("confidence"),
        (F.max("n") < 0.6 * F.sum("n")).alias("ambiguous"),
        (F.count("*") > 1).alias("mixed"),
    )


def latest_labels(analysis: DataFrame) -> DataFrame:
    """(run_id, label) of the last analysis of each run."""
    return analysis.groupBy("run_id").agg(F.max_by("detected_language", F.struct("analysed_at", "loaded_at")).alias("label"))


def page_segments(splits: DataFrame, runs: DataFrame, analysis: DataFrame, sample: int = 1200) -> DataFrame:
    """The segments of all pages with a markdown and running text but spam (p3) and residue (p4), by a model trained on all of their labels.

    The first model is fitted on `sample` labelled rows, then trained further on every labelled block. Texts are cut out of the bodies once and
    written, for residue, training and prediction; the segments are written, so that several readers don't judge the blocks again.
    """
    labels = latest_labels(analysis).select("run_id", canonical_column(F.col("label")).alias("label")).filter("label is not null")
    texts = written(page_texts(splits, runs, labels), "texts")
    features = texts.filter("block_no is null").select("run_id", "trusted", "segs")
    residue = written(linked_residue(features.unionByName(html_bodies(splits, runs, can_be_residue, FEATURES))).select("run_id"), "residue")
    blocks = texts.filter("block_no is not null").drop("trusted", "segs")
    blocks = blocks.filter("not open").unionByName(blocks.filter("open").join(residue, "run_id", "left_anti"))
    # the first rows are drawn from the labels alone; they are at most `sample` and broadcast, so no text is shuffled for them
    some = labels.orderBy(F.xxhash64("run_id")).limit(sample)
    start = train_on(splits.select("run_id", "markdown").join(F.broadcast(some), "run_id"), "run_id", "markdown", "label", sample)
    model = train_further(blocks, start, {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()})
    return written(segments(blocks, model, "run_id").dropDuplicates(["run_id", "block_no"]), "segments")


def wrong_languages(splits: DataFrame, runs: DataFrame, analysis: DataFrame, sample: int = 1200, least_words: int = 12, least_confidence: float = 0.8) -> DataFrame:
    """(run_id, block_no, lang): pages whose label isn't the language most of them is in (block_no -1), and blocks in another language."""
    seg = page_segments(splits, runs, analysis, sample)
    main = document_languages(seg, "run_id").select("run_id", F.col("lang").alias("main"))
    known = canonical_column(F.col("label"))
    page = main.join(latest_labels(analysis), "run_id", "left").filter(known.isNull() | (known != F.col("main")))
    doubt = F.col("ambiguous") | (F.col("confidence") < least_confidence)
    other = seg.join(main, "run_id").filter((F.col("lang") != F.col("main")) & (F.col("n_words") >= least_words) & ~doubt)
    return page.select("run_id", F.lit(-1).alias("block_no"), F.col("main").alias("lang")).unionByName(other.select("run_id", "block_no", "lang"))
