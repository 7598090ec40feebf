"""Joins of a large table with one row a group, where a few groups may hold much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot groups at any input size.
HOT_SHARE = 1024


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined with groups on key.  groups has one row a key, with its number of rows in the column size.

    Hot groups are broadcast (fewer than HOT_SHARE rows, whatever the input); rows of the other groups shuffle on the
    key, where no group is large.
    """
    hot = groups.filter(F.col(size) * HOT_SHARE > F.lit(total)).limit(HOT_SHARE)
    cold = groups.filter(F.col(size) * HOT_SHARE <= F.lit(total))
    with_hot = rows.join(F.broadcast(hot), key, "left")
    kept = [c for c in with_hot.columns if c not in groups.columns or c == key]
    done = with_hot.filter(F.col(size).isNotNull())
    rest = with_hot.filter(F.col(size).isNull()).select(*kept).join(cold, key, "left")
    return done.unionByName(rest)
