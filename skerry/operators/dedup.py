"""Rows kept once: first or last writes, best of a group, set operations.

All are a shuffle on the key and a rank within it. Spark's window group limit drops
what can't be first before the shuffle, so a key with a third of the rows
arrives as few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def one_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, which should end in a unique column."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def first_write(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Insert-or-ignore: the earliest row of each key."""
    return one_per_key(df, keys, [F.col(seq).asc()])


def last_write(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Insert-or-replace: the latest row of each key."""
    return one_per_key(df, keys, [F.col(seq).desc()])


def unseen(new: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new whose key isn't known."""
    return new.join(known.select(*keys).distinct(), list(keys), "left_anti")


def longest_first(df: DataFrame, key: str, text: str, seq: str) -> DataFrame:
    """Of each key the row with the longest text (ties: the earliest), with pos, the key's first place."""
    place = df.groupBy(key).agg(F.min(seq).alias("pos"))
    return one_per_key(df, [key], [F.length(text).desc(), F.col(seq).asc()]).join(place, key)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
