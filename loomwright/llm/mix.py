"""A mixture of sources by target shares of tokens, in fixed-length blocks.

The documents of each listed source are tokenized and packed one after another into blocks of `block` tokens. From a dozen
numbers (blocks and tokens of each source) the number of slots of each source follows, so that the shares are met. All slots
of all sources, numbered one source after another, go through one pseudorandom permutation whose image is the cell of the
output: cell // shard_blocks is the shard, the rest the position. So each shard's source counts are a multinomial draw
conditioned on the sources' totals, of one kind at every size, and nothing is drawn in the driver.

Slot k of a source takes the block perm_r(k mod N) of its N blocks in the round r = k // N, another permutation for each round (a
Feistel network over the indices, walked until it falls below N). Slots and blocks meet by index: as the permutation can be
inverted, each block computes the slots that take it, and no join moves the tokens.

Repeats: a source has at most `max_repeats` rounds over its blocks, so no document is taken more often. The size is the
largest at which every source that has a block reaches its share, but at most the tokens of all listed sources;
`total_tokens` sets another one: a source at its cap then stays below its share and the others make up for it in
proportion to their targets. The shares reached are reported for each source.

Scale: one shuffle of tokens, by source and bucket; a source has as many buckets as its length needs, so a hot one spreads over
many tasks. Each bucket packs its own blocks (its last one may be shorter). The driver holds one row for each listed source.

Defined results: sources that aren't listed take no share; documents with a null source, a null or an empty text, or a null id have
no tokens; a listed source without a block is reported with 0 (a source's last, partial block is padded with
nothing: it is a shorter block, so that tiny sources aren't lost); rows that repeat a doc_id count once; a target that is null or
not positive takes no share; of a source listed twice the targets add up and the smaller max_repeats counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import encode as E
from ..session import written

MOST_SOURCES = 100_000  # listed sources; their plan is held by the driver
BUCKET_CHARS = 16_000_000  # characters of a source's bucket
MOST_BUCKETS = 1_000_000  # buckets up to which their offsets are broadcast


def _rounds(bits: np.ndarray, key: np.ndarray, rounds: int) -> list[tuple[np.ndarray, ...]]:
    low = (np.uint64(1) << bits) - np.uint64(1)
    return [(low, key, np.full(len(key), r + 1, np.uint64)) for r in range(rounds)]


def _mix(right: np.ndarray, low: np.ndarray, key: np.ndarray, r: np.ndarray) -> np.ndarray:
    h = (right + r) * np.uint64(0x9E3779B97F4A7C15) ^ key
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)) & low


def feistel(x: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4, inverse: bool = False) -> np.ndarray:
    """perm_key(x) below n for every element, each with its own n and key; or the element whose image x is."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    out, todo = x.astype(np.uint64).copy(), np.ones(len(x), bool)
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    while todo.any():
        v, b = out[todo], bits[todo]
        left, right = v >> b, v & ((np.uint64(1) << b) - np.uint64(1))
        steps = _rounds(b, key[todo], rounds)
        for s in reversed(steps) if inverse else steps:
            if inverse:
                left, right = right ^ _mix(left, *s), left
            else:
                left, right = right, left ^ _mix(right, *s)
        out[todo] = (left << b) | right
        todo = out >= n
    return out.astype(np.int64)


def draw_slots(tokens: dict[str, int], blocks: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: int | None) -> dict[str, int]:
    """The number of slots (blocks of the output) of each source."""
    live = [(s, w, r) for s, w, r in targets if blocks.get(s) and w > 0 and r > 0]
    weight = sum(w for _, w, _ in live)
    if not live:
        return {}
    size = {s: tokens[s] / blocks[s] for s, _, _ in live}  # mean tokens of a block: the last may be shorter
    if total_tokens is None:
        total_tokens = min(sum(tokens[s] for s, _, _ in live), *(tokens[s] * r / (w / weight) for s, w, r in live))
    slots, open_, left = {}, list(live), float(total_tokens)
    while open_:  # sources at their cap stay there, the rest share what is left
        share = sum(w for _, w, _ in open_)
        full = [(s, w, r) for s, w, r in open_ if left * w / share / size[s] >= blocks[s] * r]
        if not full:
            for s, w, _ in open_:
                slots[s] = max(1, round(left * w / share / size[s]))
            break
        for s, _, r in full:
            slots[s] = blocks[s] * r
            left -= slots[s] * size[s]
        open_ = [x for x in open_ if x not in full]
    return slots


def _pack(block: int):
    """Packs the ids of the rows (source, bucket, doc_id, ids), which come sorted, into blocks of each bucket; a doc_id that comes twice counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, no = None, None, 0
        held: list[np.ndarray] = []  # the ids that don't fill a block yet
        docs: list = []
        n = 0
        out: list[tuple] = []

        def close(size: int) -> None:
            nonlocal held, docs, n, no
            ids = np.concatenate(held)
            out.append((*group, no, ids[:size], docs))
            no += 1
            held, n = ([ids[size:]], n - size) if n > size else ([], 0)
            docs = docs[-1:] if n else []

        for b in batches:
            lists, k = b.column(3), 0
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for source, bucket, doc in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = flat[at[k] : at[k + 1]]
                k += 1
                if (source, bucket) != group:
                    if n:
                        close(n)
                    group, last, no = (source, bucket), None, 0
                if doc == last or not len(ids):
                    continue
                last = doc
                a = 0
                while a < len(ids):
                    z = min(len(ids), a + block - n)
                    held.append(ids[a:z])
                    docs = [*docs, doc]
                    n += z - a
                    a = z
                    if n == block:
                        close(block)
                if len(out) >= 2000:
                    yield _batch(out, b.schema.field(2).type)
                    out = []
        if n:
            close(n)
        if out:
            yield _batch(out, b.schema.field(2).type)

    return run


def _batch(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
    source, bucket, no, ids, docs = zip(*rows)
    sizes = [len(x) for x in ids]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(bucket, pa.int32()), pa.array(no, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(list(docs), pa.list_(doc_type))], ["source", "bucket", "local", "n_tokens", "ids", "doc_ids"])


def listed_sources(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, most repeats) of each listed source."""
    t = targets.groupBy("source").agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("r")).filter("source is not null")
    rows = t.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources are listed")
    return sorted((r["source"], float(r["w"] or 0), int(r["r"] or 0)) for r in rows)


def token_blocks(docs: DataFrame, sources: list[str], path: str = E.DEFAULT, block: int = 256, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(source, block_no, n_tokens, ids, doc_ids) of the listed sources' documents, packed in the order (bucket, doc_id)."""
    spark = docs.sparkSession
    names = F.broadcast(spark.createDataFrame([(s,) for s in sources], "source string"))  # at most MOST_SOURCES rows
    some = docs.join(names, "source", "left_semi").filter("text is not null and text <> '' and doc_id is not null")
    # lengths alone tell how many buckets a source needs; one row for each listed source
    chars = {r["source"]: r["n"] for r in some.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    counts = spark.createDataFrame([(s, n // bucket_chars + 1) for s, n in chars.items()], "source string, _b bigint")
    keyed = some.join(F.broadcast(counts), "source").select(F.struct("source", F.pmod(F.xxhash64("doc_id"), F.col("_b")).cast("int").alias("bucket"), "doc_id").alias("_k"), "text")
    ids = E.encode(keyed, "_k", "text", path).select("_k.source", "_k.bucket", "_k.doc_id", "ids")
    sorted_ = ids.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "doc_id", F.size("ids"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    packed = written(sorted_.mapInArrow(_pack(block), f"source string, bucket int, local bigint, n_tokens bigint, ids array<int>, doc_ids array<{doc_type}>"), "packed")
    sums = packed.groupBy("source", "bucket").agg(F.count("*").alias("m"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = written(sums.select("source", "bucket", (F.sum("m").over(w) - F.col("m")).alias("base")), "base")
    few = base.count() <= MOST_BUCKETS
    return packed.join(F.broadcast(base) if few else base, ["source", "bucket"]).select("source", (F.col("base") + F.col("local")).alias("block_no"), "n_tokens", "ids", "doc_ids")


def mixture(docs: DataFrame, targets: DataFrame, path: str = E.DEFAULT, block: int = 256, total_tokens: int | None = None, shard_blocks: int = 1024, seed: int = 7, bucket_chars: int = BUCKET_CHARS) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: (shard, position, source, round, block_no, n_tokens, ids, doc_ids), one row for each block of the output.
    report: (source, target_share, actual_share, tokens_available, tokens_taken, blocks_taken, max_repeats, most_repeats).
    """
    spark = docs.sparkSession
    rows = listed_sources(targets)
    b = token_blocks(docs, [s for s, _, _ in rows], path, block, bucket_chars)
    have = {r["source"]: (r["t"], r["b"]) for r in b.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("b")).collect()}
    slots = draw_slots({s: v[0] for s, v in have.items()}, {s: v[1] for s, v in have.items()}, rows, total_tokens)
    total, first, plan = sum(slots.values()), 0, []
    for s in sorted(slots):
        plan.append((s, have[s][1], slots[s], first, _signed(hash_key(s, seed))))
        first += slots[s]
    p = F.broadcast(spark.createDataFrame(plan, "source string, _n bigint, _slots bigint, _first bigint, _key bigint"))

    @F.pandas_udf("array<struct<round:bigint,cell:bigint>>")
    def cells(at: pd.Series, n: pd.Series, slots: pd.Series, first: pd.Series, key: pd.Series) -> pd.Series:
        at, n, slots, first = (x.to_numpy(np.int64) for x in (at, n, slots, first))
        keys = key.to_numpy(np.int64).view(np.uint64)
        out: list[list[dict]] = [[] for _ in at]
        for turn in range(int((-(-slots // np.maximum(n, 1))).max()) if len(at) else 0):
            slot = turn * n + feistel(at, n, keys + np.uint64(turn) * np.uint64(0xD1B54A32D192ED03), inverse=True)
            hit = np.flatnonzero(slot < slots)
            cell = feistel(first[hit] + slot[hit], np.full(len(hit), total), np.full(len(hit), seed, np.uint64))
            for i, c in zip(hit.tolist(), cell.tolist()):
                out[i].append({"round": turn, "cell": c})
        return pd.Series(out)

    taken_by = b.join(p, "source").withColumn("x", F.explode(cells("block_no", "_n", "_slots", "_first", "_key")))
    mixed = taken_by.select(F.expr(f"x.cell div {int(shard_blocks)}").alias("shard"), (F.col("x.cell") % shard_blocks).alias("position"), "source", F.col("x.round").alias("round"), "block_no", "n_tokens", "ids", "doc_ids")
    taken = mixed.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("b"), (F.max("round") + 1).alias("most"))
    t = spark.createDataFrame([(a, w, r, have.get(a, (0, 0))[0]) for a, w, r in rows], "source string, target_share double, max_repeats int, tokens_available bigint")
    # one row for each listed source is left here: the sum over all of them is a window of that many rows
    taken = taken.withColumn("all", F.sum("t").over(Window.partitionBy()))
    report = t.join(taken, "source", "left").select(
        "source", "target_share", F.coalesce(F.col("t") / F.col("all"), F.lit(0.0)).alias("actual_share"), "tokens_available",
        F.coalesce("t", F.lit(0)).alias("tokens_taken"), F.coalesce("b", F.lit(0)).alias("blocks_taken"), "max_repeats", F.coalesce("most", F.lit(0)).alias("most_repeats"),
    )
    return mixed, report


def hash_key(source: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass"), seed)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
