"""Joins that stay spread out when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No key that holds a smaller share of the rows counts as hot; so at most this many keys are hot, whatever the data.
MAX_HOT_KEYS = 1000


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, few: int = 0) -> DataFrame:
    """Inner join of left with right, which has each key of left once and in `weight` its number of rows in left.

    Keys with over 1/1000 of all rows are at most 1000 by count, so their rows of right can be broadcast; their rows of
    left stay where they are. All other keys are joined by Spark's own choice. Both frames are read twice; hand in
    written tables. Rows of left with a null key find nothing. If left has at most `few` rows, which one task can join, all
    keys are joined by Spark's own choice: one join instead of three, for callers whose many plans fill the driver's memory.
    """
    total = right.agg(F.sum(weight).alias("n")).first()["n"] or 0
    right_all = right.drop(weight)
    if few and total <= few:
        return left.join(right_all, key, "inner")
    hot = right.filter(F.col(weight) * MAX_HOT_KEYS > F.lit(total)).drop(weight)
    hot_part = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right_all, key, "inner")
    return hot_part.unionByName(rest)
