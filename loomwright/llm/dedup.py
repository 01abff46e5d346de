"""Records that differ only in how they are written, collapsed with their number of copies.

Each record's fields are cut into normalized (name, value) pairs: letter case, white space and punctuation are
dropped, percent escapes are read as their characters, the parameters of a query are pairs of their own without an
order. Every pair is hashed (two independent 64-bit hashes) and the hashes are combined by a commutative multiset
hash: the lanes' sums and the number of pairs, which no order of the pairs changes and in which equal pairs don't
cancel. Records are grouped by the fingerprint; then the pairs of each record are compared with those of its group's
representative as multisets, without sorting, and what differs (a collision) is grouped again by its pairs.

Everything is JVM expressions. The pairs' arrays never leave the scan's stage except in the group's representative
and for the comparison. Group sizes are counted before the shuffle (partial aggregation); the representatives of hot groups, of
which there can be few, are broadcast and their records don't move (see `hot`).

Defined results: a null field equals only null; '' and a field of punctuation only equal each other; a record whose
fields are all null has copies among such records; repeated rows with the same id count once; rows without
an id are left out; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .hot import HOT, join_groups
from ..session import written

NOT_LETTERS = r"[^\p{L}\p{N}\p{M}]+"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"


def normalized(text: Column) -> Column:
    """Lower case, escapes read as characters, only letters, digits and marks kept."""
    # a % that begins no escape is punctuation; + is punctuation as well, so that decoding it as a space does no harm
    plain = F.when(F.instr(text, "%") > 0, F.coalesce(F.try_url_decode(F.regexp_replace(text, BAD_ESCAPE, "")), text)).otherwise(text)
    return F.regexp_replace(F.lower(plain), NOT_LETTERS, "")


def url_pairs(url: Column, field: str) -> Column:
    """The (name, value) pairs of one address: what stands before the query, and each parameter that isn't empty."""
    head = F.substring_index(url, "?", 1)
    rest = F.when(F.instr(url, "?") > 0, F.substring(url, F.length(head) + 2, F.length(url))).otherwise(F.lit(""))
    fragment = F.when(F.instr(rest, "#") > 0, F.substring_index(rest, "#", -1)).otherwise(F.lit(""))
    query = F.substring_index(rest, "#", 1)
    parts = F.filter(F.split(query, "[&;]"), lambda p: F.length(normalized(p)) > 0)
    params = F.transform(
        parts,
        lambda p: F.struct(
            F.concat(F.lit(f"{field}?"), normalized(F.substring_index(p, "=", 1))).alias("n"),
            normalized(F.when(F.instr(p, "=") > 0, F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).otherwise(F.lit(""))).alias("v"),
        ),
    )
    main = F.array(F.struct(F.lit(field).alias("n"), F.concat(normalized(head), normalized(fragment)).alias("v")))
    null = F.array(F.struct(F.lit(f"{field}!null").alias("n"), F.lit("").alias("v")))
    return F.when(url.isNull(), null).otherwise(F.concat(main, params))


def plain_pairs(value: Column, field: str) -> Column:
    """The pair of a plain text field."""
    return F.array(F.when(value.isNull(), F.struct(F.lit(f"{field}!null").alias("n"), F.lit("").alias("v"))).otherwise(F.struct(F.lit(field).alias("n"), normalized(value).alias("v"))))


def multiset_hash(pairs: Column, seed: int = 0) -> Column:
    """A commutative fingerprint of the pairs: their number and the sums of four 32-bit lanes of two 64-bit hashes."""
    mask = F.lit(0xFFFFFFFF)

    def lanes(p: Column) -> Column:
        a, b = F.xxhash64(F.lit(seed), p["n"], p["v"]), F.xxhash64(F.lit(0x9E3779B9 + seed), p["v"], p["n"])
        return F.struct(
            F.lit(1).cast("bigint").alias("k"),
            a.bitwiseAND(mask).alias("a"),
            F.shiftrightunsigned(a, 32).alias("b"),
            b.bitwiseAND(mask).alias("c"),
            F.shiftrightunsigned(b, 32).alias("d"),
        )

    zero = F.struct(*(F.lit(0).cast("bigint").alias(x) for x in "kabcd"))
    return F.aggregate(F.transform(pairs, lanes), zero, lambda s, x: F.struct(*((s[c] + x[c]).alias(c) for c in "kabcd")))


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements equally often, without sorting."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    # most pairs stand in the same order; counting is for the others
    return (a == b) | ((F.size(a) == F.size(b)) & F.forall(a, lambda x: count(a, x) == count(b, x)))


def with_pairs(df: DataFrame, id_col: str, url_fields: Sequence[str] = (), text_fields: Sequence[str] = ()) -> DataFrame:
    """(_id, _pairs) of each record."""
    arrays = [url_pairs(F.col(f), f) for f in url_fields] + [plain_pairs(F.col(f), f) for f in text_fields]
    pairs = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    return df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), pairs.alias("_pairs"))


def fingerprints(records: DataFrame, seed: int = 0) -> DataFrame:
    """(_id, _pairs, _f1, _f2) of each record."""
    # the 160 bits of the fingerprint are hashed once more to 128, which is what is shuffled
    h = multiset_hash(F.col("_pairs"), seed)
    return records.select("_id", "_pairs", h.alias("_h")).select("_id", "_pairs", F.xxhash64("_h").alias("_f1"), F.xxhash64(F.lit(7), "_h").alias("_f2"))


def _verified(records: DataFrame, seed: int, hot: int) -> DataFrame:
    """(rep, id) of the records in groups of two or more, each compared with its group's representative field by field."""
    d = fingerprints(records, seed)
    keys = ["_f1", "_f2"]
    groups = d.groupBy(*keys).agg(F.min(F.struct("_id", "_pairs")).alias("_r"), F.max("_id").alias("_last"), F.count("*").alias("_n"))
    groups = groups.filter(F.col("_last") > F.col("_r._id")).select(*keys, "_n", F.col("_r._id").alias("rep"), F.col("_r._pairs").alias("_rp"))
    # written: the groups are read for the hot ones and for the others
    joined = join_groups(d, written(groups, "groups"), keys, "_n", hot).select("_id", "_pairs", "rep", same_multiset(F.col("_pairs"), F.col("_rp")).alias("_same"))
    joined = written(joined, "members")
    right = joined.filter("_same").select("rep", F.col("_id").alias("id"))
    # other records under one fingerprint: none in practice; they are grouped again among themselves by another hash
    rest = joined.filter("not _same")
    return right if rest.isEmpty() else right.unionByName(_verified(rest.select("_id", "_pairs"), seed + 1, hot))


def copies(df: DataFrame, id_col: str, url_fields: Sequence[str] = (), text_fields: Sequence[str] = (), hot: int = HOT) -> DataFrame:
    """(rep, id): each record in a group of two or more with the smallest id of its group, the representative too."""
    return _verified(with_pairs(df, id_col, url_fields, text_fields), 0, hot).distinct()


def copy_counts(df: DataFrame, id_col: str, url_fields: Sequence[str] = (), text_fields: Sequence[str] = (), hot: int = HOT) -> DataFrame:
    """(rep, n_copies): one row for each different record with the number of its copies, itself among them.

    The copies are those of `copies`, verified field by field; every record that is none of theirs counts as one.
    """
    found = written(copies(df, id_col, url_fields, text_fields, hot), "copies")
    groups = found.groupBy("rep").agg(F.count("*").alias("n_copies"))
    alone = df.select(F.col(id_col).alias("rep")).filter("rep is not null").distinct().join(found.select(F.col("id").alias("rep")), "rep", "left_anti")
    return groups.unionByName(alone.withColumn("n_copies", F.lit(1).cast("bigint")))
