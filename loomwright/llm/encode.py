"""Texts as token ids of a public byte-level tokenizer, and back.

The tokenizers library encodes Arrow batches; its byte-to-character table is rebuilt here for decoding, so that ids
are read as bytes and a character split over several tokens comes out whole. Offsets are in characters of the text.

Defined results: null and empty texts have an empty list of ids; strings of special tokens in a text are ordinary
text; decoding an id that isn't in the vocabulary gives nothing for it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT = "/opt/tokenizers/byte_bpe_50k.json"
PIECE = 1 << 20  # characters of text handed to the library at once; a batch of Arrow rows is cut there, no text is


@lru_cache(maxsize=4)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {chr(b): b for b in own}
    n = 0
    for b in range(256):
        if b not in own:
            table[chr(256 + n)] = b
            n += 1
    return table


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE characters together."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode(df: DataFrame, id_col: str, text_col: str, path: str = DEFAULT, offsets: bool = False) -> DataFrame:
    """(id, ids) or, with offsets, (id, ids, starts, ends) of each row; map-only."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        many = tok.encode_batch if offsets else getattr(tok, "encode_batch_fast", tok.encode_batch)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, z in _runs(texts):
                done = many([t or "" for t in texts[a:z]], add_special_tokens=False)
                cols = [batch.column(0).slice(a, z - a), pa.array([e.ids for e in done], pa.list_(pa.int32()))]
                names = [id_col, "ids"]
                if offsets:
                    at = [e.offsets for e in done]
                    cols += [pa.array([[x[k] for x in o] for o in at], pa.list_(pa.int32())) for k in (0, 1)]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else ""))


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    tok, table = load(path), byte_table()
    out = []
    for i in range(tok.get_vocab_size(with_added_tokens=True)):
        s = tok.id_to_token(i) or ""
        out.append(bytes(table[c] for c in s) if all(c in table for c in s) else s.encode())
    return out


def decode(df: DataFrame, id_col: str, ids_col: str = "ids", path: str = DEFAULT) -> DataFrame:
    """(id, text): the bytes of all ids of a row joined, then read as UTF-8; a null list gives a null text.

    Bytes that aren't UTF-8 (a list cut within a character) become U+FFFD each.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        n = len(table)
        for batch in batches:
            texts = [None if ids is None else b"".join(table[i] for i in ids if i is not None and 0 <= i < n).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")
