"""Preparation statistics learned on a training part and applied to any part."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.numeric import missing_to_null
from ballast.operators.columns import quoted
from ballast.operators.order_stats import column_summaries, order_statistics


@dataclass(frozen=True)
class Preparation:
    """Per column: the fill value, the mean and the deviation of the filled column."""

    columns: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    def impute(self, df: DataFrame) -> DataFrame:
        """Missing values (NULL and NaN) become the median."""
        return df.withColumns(
            {
                c: F.coalesce(missing_to_null(quoted(c).cast("double")), F.lit(m))
                for c, m in zip(self.columns, self.medians)
            }
        )

    def scale(self, df: DataFrame) -> DataFrame:
        """Columns to mean 0 and population deviation 1; constant columns to 0."""
        return df.withColumns(
            {
                c: (quoted(c) - F.lit(mean)) / F.lit(dev or 1.0)
                for c, mean, dev in zip(self.columns, self.means, self.deviations)
            }
        )

    def sql(self) -> str:
        """The same preparation as a statement a Spark ML ``SQLTransformer`` can store."""
        parts = []
        for c, med, mean, dev in zip(self.columns, self.medians, self.means, self.deviations):
            filled = f"coalesce(nanvl(cast(`{c}` as double), cast(null as double)), {_literal(med)})"
            parts.append(f"({filled} - {_literal(mean)}) / {_literal(dev or 1.0)} as `{self.prepared_name(c)}`")
        return f"SELECT *, {', '.join(parts)} FROM __THIS__"

    @staticmethod
    def prepared_name(column: str) -> str:
        return f"{column}__prepared"


def _literal(x: float) -> str:
    return f"cast('{x!r}' as double)"


def fit_preparation(train: DataFrame, columns: Sequence[str]) -> Preparation:
    """Medians, then mean and deviation of the filled columns; a column without values fills with 0.

    The moments of a filled column follow from those of its observed values, so one
    pass over the values gives them and the extremes; the medians are searched for by counting.
    """
    rows = column_summaries(train, columns)
    searched = order_statistics(train, columns, [0.5], summaries=rows)
    medians, means, deviations = [], [], []
    for i, c in enumerate(columns):
        row = rows.get(i)
        if row is None or not row.n:
            fill, mean, variance = 0.0, 0.0, 0.0
        else:
            fill = searched[c][0]
            filled = (row.total - row.n) / row.total
            mean = row.mean + filled * (fill - row.mean)
            variance = (1 - filled) * (row.variance + (row.mean - mean) ** 2) + filled * (fill - mean) ** 2
        medians.append(fill)
        means.append(mean)
        deviations.append(math.sqrt(variance))
    return Preparation(tuple(columns), tuple(medians), tuple(means), tuple(deviations))


def median_impute(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Fill missing values with the medians of the training part."""
    medians = order_statistics(train if train is not None else df, columns, [0.5])
    values = tuple(q[0] if q[0] is not None else 0.0 for q in medians.values())
    return Preparation(tuple(columns), values, (), ()).impute(df)


def standard_scale(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Standardise with mean and deviation of the training part, missing values kept out."""
    source = train if train is not None else df
    row = source.agg(
        *[F.avg(missing_to_null(quoted(c))).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(missing_to_null(quoted(c))).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    n = len(columns)
    stats = Preparation(
        tuple(columns), (), tuple(row[i] or 0.0 for i in range(n)), tuple(row[n + i] or 0.0 for i in range(n))
    )
    return stats.scale(df)
