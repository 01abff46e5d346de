"""Deeply nested records as related flat tables.

Each record is read once into a stream of triples (path, value, ordinal); paths are grouped by their repeated
ancestor, and each group is pivoted into one table whose rows keep the path of their parent row and their record.

A triple belongs to an object. Its path names the object with the position of every list on the way
(``scores.seo.technical[0].checks[2]``), its group is the same path without positions (``scores.seo.technical.checks``),
its field and value are one scalar of the object, and its ordinal is the object's position in its list. An object
without scalars still has one triple, with a null field, so that it keeps its row. Rules:

* a list gives its objects by position from 0; null elements and scalars keep their position and give no row;
* a single object where a list could stand is a list of one; a list in a list continues the path with a second position;
* a string that is a JSON object or list counts as its content;
* null, empty, blank and invalid bodies give nothing; of a repeated key the last one counts;
* numbers keep their text, so no digit of a long number is lost; half a surrogate pair, escaped alone, becomes U+FFFD;
* a dot in a key is written as %2E in groups, and % as %25, so that the key b.c and the path from b to c are two groups.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TRIPLES = "parent_path string, object_path string, object_group string, ordinal int, field string, value string, kind string"


def _no_constant(s: str) -> Any:
    raise ValueError(s)


_DECODER = json.JSONDecoder(parse_int=lambda s: _Number(s), parse_float=lambda s: _Number(s), parse_constant=_no_constant)


class _Number(str):
    """A number by its text."""

    __slots__ = ()


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')


def _deep(text: str) -> Any:
    """The value of a JSON text nested too deeply for the library's parser, read token by token with a stack of its own."""
    stack: list[Any] = []
    keys: list[str | None] = []
    root: list[Any] = []
    state, pos, end = "value", 0, len(text.rstrip(" \t\n\r"))

    def put(v: Any) -> None:
        if not stack:
            root.append(v)
        elif isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = v
        else:
            stack[-1].append(v)

    while pos < end:
        m = _TOKEN.match(text, pos)
        if not m or m.end() == pos:
            raise ValueError("not JSON")
        pos = m.end()
        sign = m[1]
        if state in ("value", "first") and (sign in ("{", "[") or m[2] or m[3] or m[4]):
            if sign:
                v: Any = {} if sign == "{" else []
                put(v)
                stack.append(v)
                keys.append(None)
                state = "key0" if sign == "{" else "first"
                continue
            put(json.loads(m[2]) if m[2] else _Number(m[3]) if m[3] else json.loads(m[4]))
            state = "after"
        elif state in ("key", "key0") and m[2]:
            keys[-1] = json.loads(m[2])
            state = "colon"
        elif state == "colon" and sign == ":":
            state = "value"
        elif state == "after" and sign == "," and stack:
            state = "key" if isinstance(stack[-1], dict) else "value"
        elif stack and sign == ("}" if isinstance(stack[-1], dict) else "]") and state in ("after", "key0", "first"):
            stack.pop()
            keys.pop()
            state = "after"
        else:
            raise ValueError("not JSON")
        if state == "after" and not stack and pos < end:
            raise ValueError("not JSON")
    if stack or len(root) != 1:
        raise ValueError("not JSON")
    return root[0]


def parse_json(text: str) -> Any:
    """The value of a JSON text; ValueError if it isn't valid."""
    s = text.strip(" \t\n\r")
    try:
        return _DECODER.decode(s)
    except RecursionError:
        return _deep(s)


def _whole(s: str | None) -> str | None:
    """The text with U+FFFD for every half of a surrogate pair, which JSON may escape alone and UTF-8 can't hold."""
    return s if s is None else re.sub("[\ud800-\udfff]", "\ufffd", s)


def _content(v: Any) -> Any:
    """A string that is a JSON object or list as its content, to any depth; everything else as it is."""
    while isinstance(v, str) and not isinstance(v, _Number):
        s = v.strip(" \t\n\r")
        if s[:1] not in ("{", "[") or s[-1:] not in ("}", "]"):
            return v
        try:
            v = parse_json(s)
        except ValueError:
            return v
    return v


def _scalar(v: Any) -> tuple[str | None, str]:
    if v is None:
        return None, "null"
    if isinstance(v, bool):
        return ("true" if v else "false"), "boolean"
    if isinstance(v, _Number):
        return str(v), "number"
    return v, "string"


def _step(key: str) -> str:
    return key.replace("%", "%25").replace(".", "%2E") if "." in key or "%" in key else key


def triples(value: Any, path: str) -> Iterator[tuple[str, str, str, int, str | None, str | None, str]]:
    """The triples of what stands at one path of a record, in document order, without recursion."""
    # (value, path with positions, group, parent's path, ordinal)
    todo: list[tuple[Any, str, str, str, int]] = [(_content(value), path, path, "", -1)]
    while todo:
        v, at, group, parent, ordinal = todo.pop()
        if isinstance(v, list):
            todo.extend((c, f"{at}[{i}]", group, parent, i) for i, x in reversed(list(enumerate(v))) if isinstance(c := _content(x), (list, dict)))
            continue
        if not isinstance(v, dict):
            continue
        if ordinal < 0:
            at, ordinal = f"{at}[0]", 0
        yield parent, at, group, ordinal, None, None, "object"
        inner = []
        for k, x in v.items():
            c = _content(x)
            if isinstance(c, (list, dict)):
                inner.append((c, f"{at}.{k}", f"{group}.{_step(k)}", at, -1))
            else:
                value_, kind = _scalar(c)
                yield parent, at, group, ordinal, k, value_, kind
        todo.extend(reversed(inner))


def record_triples(df: DataFrame, id_col: str, body_col: str, roots: Sequence[str]) -> DataFrame:
    """(id, parent_path, object_path, object_group, ordinal, field, value, kind) of the objects under the given paths.

    One pass over the records without a shuffle; only the id and the body reach Python.
    """
    roots = list(roots)
    id_type = df.schema[id_col].dataType
    names = ["parent_path", "object_path", "object_group", "ordinal", "field", "value", "kind"]
    arrow = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take: list[int] = []
            rows: list[tuple] = []
            for i, body in enumerate(batch.column(1).to_pylist()):
                if not body:
                    continue
                try:
                    record = parse_json(body)
                except ValueError:
                    continue
                for root in roots:
                    v = record
                    for step in root.split("."):
                        v = _content(v)
                        v = v.get(step) if isinstance(v, dict) else None
                    for t in triples(v, root):
                        take.append(i)
                        rows.append(t)
                if len(rows) > 50_000:
                    yield out(batch, take, rows)
                    take, rows = [], []
            yield out(batch, take, rows)

    def out(batch: pa.RecordBatch, take: list[int], rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        ids = batch.column(0).take(pa.array(take, pa.int64()))
        try:
            arrays = [pa.array(c, t) for c, t in zip(cols, arrow)]
        except UnicodeEncodeError:
            arrays = [pa.array([_whole(x) for x in c] if t == pa.string() else c, t) for c, t in zip(cols, arrow)]
        return pa.RecordBatch.from_arrays([ids, *arrays], [id_col, *names])

    return df.select(id_col, body_col).mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, {TRIPLES}")


def objects(triples_df: DataFrame, id_col: str) -> DataFrame:
    """One row for each object: (id, child_path, parent_path)."""
    return triples_df.filter(F.col("kind") == "object").select(id_col, F.col("object_path").alias("child_path"), "parent_path")


def pivot_group(triples_df: DataFrame, id_col: str, group: str, fields: Sequence[str]) -> DataFrame:
    """The flat table of one group: (id, row_path, parent_path, ordinal, one string column for each field, extra).

    ``extra`` has the object's other scalars as (field, value) pairs, so no field is lost when a record brings one more. A field
    that the object lacks or that is null is null. Columns are named f_<field>, so no field clashes with a key column.
    """
    t = triples_df.filter(F.col("object_group") == group)
    known = F.col("field").isin(list(fields))
    return t.groupBy(id_col, F.col("object_path").alias("row_path")).agg(
        F.first("parent_path").alias("parent_path"),
        F.first("ordinal").alias("ordinal"),
        *(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"f_{f}") for f in fields),
        F.array_sort(F.collect_set(F.when(F.col("field").isNotNull() & ~known, F.struct("field", "value")))).alias("extra"),
    )
