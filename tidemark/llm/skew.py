"""Joins with groups whose sizes are known: no key lands in one task, however many rows it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot with more than one row in so many of all; at most so many groups can be.
HOT = 1024


def joined(rows: DataFrame, groups: DataFrame, key: list[str], total: int, how: str = "left") -> DataFrame:
    """`rows` joined with `groups` (the key, once each and without nulls; `n`, how many of the `total` rows it has; values), n left out.

    Hot groups, at most `HOT` by their own counts, are broadcast, so their rows stay where they are; all other
    groups are joined as Spark sees fit.  Each row is in one of the two.
    """
    hot = groups.where(F.col("n") > total / HOT).drop("n")
    rest = groups.where(F.col("n") <= total / HOT).drop("n")
    there = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key, how)
    return there.unionByName(others)
