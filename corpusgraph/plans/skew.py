"""Joins of rows with one row per group, whatever the size of the largest group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is heavy from this part of all rows on, so at most so many groups are.
HEAVY_PARTS = 1000


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str = "n", how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with ``groups`` (written, one row a key, ``count`` its rows), without ``count``.

    Heavy groups are at most HEAVY_PARTS by their definition; they are broadcast and their rows
    stay where they are.  All others are joined by a shuffle, whose largest key then holds less
    than one part in HEAVY_PARTS of the rows.  ``rows`` is read twice where a group is heavy.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    is_heavy = F.col(count) * HEAVY_PARTS > total
    heavy = groups.where(is_heavy).drop(count)
    if total < HEAVY_PARTS or heavy.isEmpty():
        return rows.join(groups.drop(count), keys, how)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(groups.where(~is_heavy).drop(count), keys, how)
    return light.unionByName(rows.join(F.broadcast(heavy), keys))
