"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000  # a key is hot above one thousandth of the rows: at most 999 keys are
HOT_FLOOR = 10_000  # keys with fewer rows are never worth separate treatment


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to a table with unique keys, whatever the spread of keys in ``left``.

    Rows of hot keys meet their match by broadcast: since a hot key holds more than
    1/1000 of the rows, fewer than 1000 rows of ``right`` are sent. The other keys
    are shuffled as usual. ``left`` is read twice and should be stored or cheap.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    total = left.count()
    floor = max(total // HOT_SHARE, HOT_FLOOR)
    hot = [row[key] for row in counts.where(F.col("_n") > floor).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    heavy = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    rest = left.where(~is_hot | F.col(key).isNull()).join(right.where(~is_hot), key, how)
    return heavy.unionByName(rest)
