"""Exploration: counts, shares, missing values and summary statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.dates import parse_month
from ballast.functions.numeric import missing_to_null
from ballast.operators.columns import FLOATS, INTEGERS, columns_of, quoted
from ballast.operators.order_stats import order_statistics


def class_counts(df: DataFrame, target: str = "target", keys: Sequence[str] = ()) -> DataFrame:
    """Rows per class."""
    return df.groupBy(*keys, target).agg(F.count("*").alias("n"))


def imbalance_ratio(df: DataFrame, target: str = "target", keys: Sequence[str] = ()) -> DataFrame:
    """Largest class over smallest class."""
    counts = class_counts(df, target, keys)
    return counts.groupBy(*keys).agg((F.max("n") / F.min("n")).alias("imbalance_ratio"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(quoted(column)).distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Count and share of the whole for each value.

    The total is a scalar subquery over the counts, so columns with very many
    values are not drawn into one window partition.
    """
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.select(column, "n", (F.col("n") / total).alias("share"))


def default_rate(df: DataFrame, condition: Column) -> DataFrame:
    """Share of rows that meet a condition."""
    return df.agg((F.count_if(condition) / F.count("*")).alias("default_rate"))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column, most missing first; one pass."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(quoted(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot("_rows", list(map(quoted, df.columns)), "column_name", "missing")
    return long.select(
        "column_name", "missing", (F.col("missing") * 100 / F.col("_rows")).alias("missing_pct")
    ).orderBy(F.desc("missing_pct"), "column_name")


def describe(df: DataFrame) -> DataFrame:
    """Count, missing, mean, deviation, extremes and nearest-rank quartiles per numeric column."""
    numeric = columns_of(df, *FLOATS, *INTEGERS)
    whole = df.select(*[missing_to_null(quoted(c).cast("double")).alias(c) for c in numeric])
    moments = whole.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).alias("v")) for c in numeric])
        ).alias("p")
    ).select("p.*")
    summary = moments.groupBy("column_name").agg(
        F.count("v").alias("n"),
        F.count_if(F.col("v").isNull()).alias("missing"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    quartiles = order_statistics(whole, numeric, [0.25, 0.5, 0.75], interpolation="nearest")
    rows = [(c, *quartiles[c]) for c in numeric]
    table = df.sparkSession.createDataFrame(rows, "column_name string, q25 double, q50 double, q75 double")
    return summary.join(F.broadcast(table), "column_name")


def min_max_date(df: DataFrame, column: str) -> DataFrame:
    """First and last month of a month-text column, compared as dates."""
    month = parse_month(F.col(column))
    return df.agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"))
