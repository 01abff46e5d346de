"""Lines that stand on many documents of one source.

The letters of each document (outside tags, scripts and styles, entities read, case dropped) are cut into chunks by
content: a rolling hash over a window of letters ends a chunk where its low bits are zero, so a cut depends only on
the letters around it. A line's end ends a chunk as well and the hash starts anew there, because the cases are
defined on lines; thus the same line always gives the same chunks, whatever stands around it. Per source and chunk
the different documents are counted, and the lines whose every chunk stands on too many are cut out; of lines of several chunks
the documents of the whole line are counted too.

Scale: one pass in Python (Arrow batches) gives 128-bit keys of (source, chunk), seeded with the source, so a hot
source spreads over its chunks. Counts are aggregated before the shuffle. Chunks on a large part of all documents are
joined by broadcast, of which there can be few, all others by a shuffle (see `hot`).

Defined results: a null source is a source of its own; a null or empty text has no lines; a line without letters
doesn't count; several equal lines of one document are one document and each an occurrence; repeated rows of one
document count once; rows without an id are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .hot import HOT, join_groups
from ..session import written

OUTSIDE = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<[a-zA-Z/!?][^<>]*>", re.S | re.I)
NOT_LETTER = re.compile(r"[\W\d_]+")
WINDOW, MASK = 16, 63


def _keep_ends(m: re.Match) -> str:
    return "\n" * m[0].count("\n")


def line_letters(text: str) -> list[str]:
    """The letters of each line, in lower case; lines are cut at line feeds and numbered from 0."""
    if "<" in text:
        text = OUTSIDE.sub(_keep_ends, text)
    lines = text.split("\n")
    if "&" in text:
        lines = [html.unescape(x) if "&" in x else x for x in lines]
    return [NOT_LETTER.sub("", x.lower()) if x else "" for x in lines]


_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WINDOW)], np.uint64)


def chunk_ends(letters: str) -> list[int]:
    """Ends of the chunks of one line's letters: where the rolling hash of the last WINDOW letters has its low bits zero, and the end."""
    n = len(letters)
    if n <= WINDOW:
        return [n]
    code = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # a polynomial hash of every window; the sum over the window's positions is the rolling update in closed form
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        h += code[i : n - WINDOW + 1 + i] * _POWERS[i]
    h ^= h >> np.uint64(29)
    at = np.nonzero((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & np.uint64(MASK) == 0)[0] + WINDOW
    ends = at.tolist()
    if not ends or ends[-1] != n:
        ends.append(n)
    return ends


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def line_chunks(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, line_no, pos, n, c1, c2, k1, k2, first) for each chunk of each line.

    pos, n: the chunk's place in its line and the number of the line's chunks. c1, c2: the 128-bit key of (source, chunk).
    k1, k2: that of (source, line) where n > 1, else null. first: whether the chunk is the document's first of its kind, so that
    counting those counts documents.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.bool_()]
    names = ["line_no", "pos", "n", "c1", "c2", "k1", "k2", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h128, h64 = xxhash.xxh3_128_intdigest, xxhash.xxh3_64_intdigest
        low = (1 << 64) - 1
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                take: list[int] = []
                rows: list[tuple] = []
                for i, (source, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    if not text:
                        continue
                    seed = h64(b"\0" if source is None else b"\1" + source.encode("utf-8", "surrogatepass"))
                    seen: set[int] = set()
                    for line, letters in enumerate(line_letters(text)):
                        if not letters:
                            continue
                        ends = chunk_ends(letters)
                        k1 = k2 = None
                        if len(ends) > 1:
                            key = h128(letters.encode("utf-8", "surrogatepass"), seed)
                            k1, k2 = _signed(key >> 64), _signed(key & low)
                        start = 0
                        for pos, end in enumerate(ends):
                            c = h128(letters[start:end].encode("utf-8", "surrogatepass"), seed)
                            take.append(i)
                            rows.append((line, pos, len(ends), _signed(c >> 64), _signed(c & low), k1, k2, c not in seen))
                            seen.add(c)
                            start = end
                cols = list(zip(*rows)) if rows else [[] for _ in names]
                ids = batch.column(0).take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", *names])

    out = f"id {id_type}, line_no int, pos int, n int, c1 bigint, c2 bigint, k1 bigint, k2 bigint, first boolean"
    return df.filter(F.col(id_col).isNotNull()).select(id_col, source_col, text_col).mapInArrow(run, out)


def _documents(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, docs): those on `least` different documents or more, exactly; repeated rows of a document count once."""
    return rows.select(*keys, "id").distinct().groupBy(*keys).agg(F.count("*").alias("docs")).filter(F.col("docs") >= least)


def repeated_chunks(chunks: DataFrame, least: int, hot: int = HOT) -> DataFrame:
    """The rows of chunks that stand on `least` different documents of their source or more."""
    keys = ["c1", "c2"]
    # counted where they are read: of a frequent chunk one row for each task moves. Rows of one document may be repeated, so
    # this is an upper bound
    often = chunks.filter("first").groupBy(*keys).agg(F.count("*").alias("m")).filter(F.col("m") >= least)
    some = written(join_groups(chunks, often, keys, "m", hot), "frequent")
    return join_groups(some, _documents(some.filter("first"), keys, least), keys, "docs", hot)


def repeated_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, least: int = 6, hot: int = HOT) -> DataFrame:
    """(id, line_no) of every occurrence of a line on `least` different documents or more of its source.

    The chunks decide: a line is cut if each of its chunks stands on so many documents. Of a line of one chunk that is
    the count of the line itself; lines of several chunks, which may have come together otherwise elsewhere, are counted once more as a whole.
    """
    # written once: the counts and the cuts read it, and the letters are cut no second time
    chunks = written(line_chunks(df, id_col, source_col, text_col), "chunks")
    cut = written(repeated_chunks(chunks, least, hot).select("id", "line_no", "pos", "n", "k1", "k2"), "cut")
    whole = cut.filter("n > 1").distinct().groupBy("id", "line_no", "k1", "k2", "n").agg(F.count("*").alias("m")).filter("m = n").select("id", "line_no", "k1", "k2")
    long = join_groups(whole, _documents(whole, ["k1", "k2"], least), ["k1", "k2"], "docs", hot)
    return cut.filter("n = 1").select("id", "line_no").unionByName(long.select("id", "line_no")).distinct()


def without_lines(df: DataFrame, lines: DataFrame, id_col: str, text_col: str, out_col: str = "text_without") -> DataFrame:
    """The documents with the given lines cut out of each text; (id, out_col), null texts stay null.

    The lines' numbers of one document are at most the document's own lines, so a group is bounded by its document.
    """
    cut = lines.groupBy("id").agg(F.collect_set("line_no").alias("_cut"))
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).join(cut, "id", "left")
    numbered = F.transform(F.split("_text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.transform(F.filter(numbered, lambda s: ~F.array_contains(F.col("_cut"), s["i"])), lambda s: s["x"])
    return d.select("id", F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias(out_col))
