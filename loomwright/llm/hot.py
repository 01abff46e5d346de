"""Joins whose other side is one row for each group, of which a few may hold a large part of all rows.

The groups' sizes are known. Those above `hot` rows are at most total / hot groups, so they are broadcast and their rows never
move; the rest is joined by a shuffle in which no key has more than `hot` rows. No row is dropped or sampled and no number of
salts has to be guessed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HOT = 1_000_000


def join_groups(rows: DataFrame, groups: DataFrame, on: Sequence[str], size: str, hot: int = HOT) -> DataFrame:
    """rows joined (inner) to their group, with the groups' other columns; `size` is the groups' column of sizes and isn't returned.

    `on` are columns of both sides without nulls; rows is read twice, so it should be a written table or cheap.
    """
    on = list(on)
    other = [c for c in groups.columns if c not in (*on, size)]
    big = F.broadcast(groups.filter(F.col(size) > hot).select(*on, *other))
    flag = F.broadcast(groups.filter(F.col(size) > hot).select(*on))
    rest = groups.filter(F.col(size) <= hot).select(*on, *other)
    return rows.join(big, on).unionByName(rows.join(flag, on, "left_anti").join(rest, on))
