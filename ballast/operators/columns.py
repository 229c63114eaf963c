"""Schema-driven column operators."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.numeric import inf_to_nan
from ballast.functions.text import title_case
from ballast.vocabulary import label_table

FLOATS = (T.FloatType, T.DoubleType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def select_numeric(df: DataFrame) -> DataFrame:
    """The double columns."""
    return df.select(*map(quoted, columns_of(df, T.DoubleType)))


def matching_columns(df: DataFrame, pattern: str) -> list[str]:
    """Names that contain a match of a regular expression."""
    return [c for c in df.columns if re.search(pattern, c)]


def select_by_pattern(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(*map(quoted, matching_columns(df, pattern)))


def rename_target(df: DataFrame, name: str) -> DataFrame:
    """Call the column ``name`` (which may hold dots) ``target``."""
    return df.select(*[quoted(c).alias("target" if c == name else c) for c in df.columns])


def cast_by_class(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Floats to 32-bit float, integers to 32-bit integer; overflow raises.

    Columns named in ``keep`` stay as they are.
    """
    out = []
    for field in df.schema.fields:
        column = quoted(field.name)
        if field.name not in keep and isinstance(field.dataType, FLOATS):
            column = column.cast("float").alias(field.name)
        elif field.name not in keep and isinstance(field.dataType, INTEGERS):
            column = column.cast("int").alias(field.name)
        out.append(column)
    return df.select(*out)


def category_levels(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> dict[str, list[str]]:
    """Sorted distinct values of each column, found in one pass.

    Each level becomes a column of the result, so the levels are as many as a table
    can have columns. With ``limit`` a column that has more levels raises.
    """
    found = df.agg(*[F.collect_set(quoted(c).cast("string")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    levels = {c: sorted(found[i]) for i, c in enumerate(columns)}
    large = [c for c, values in levels.items() if limit is not None and len(values) > limit]
    if large:
        raise ValueError(f"more than {limit} levels in {large}")
    return levels


def one_hot_drop_first(
    df: DataFrame, columns: Sequence[str], levels: dict[str, list[str]] | None = None
) -> DataFrame:
    """Replace category columns by 0/1 columns ``column_value``.

    The smallest value of each column has no column of its own; missing values
    are 0 everywhere.
    """
    levels = levels or category_levels(df, columns)
    out = []
    for c in df.columns:
        if c not in columns:
            out.append(quoted(c))
            continue
        text = quoted(c).cast("string")
        out += [F.coalesce((text == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in levels[c][1:]]
    return df.select(*out)


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Strip everything but letters, digits and underscores from column names."""
    names = [re.sub(r"[^A-Za-z0-9_]+", "", c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns would share the names {clashes}")
    return df.toDF(*names)


def split_xy(df: DataFrame) -> tuple[list[str], str]:
    """Feature names and the target name; rows of Spark have no order to align two tables by."""
    if "target" not in df.columns:
        raise ValueError("no target column in the table")
    return [c for c in df.columns if c not in ("target", "row_id")], "target"


def clean_features(df: DataFrame) -> DataFrame:
    """Infinities in float features become NaN; integers are left alone."""
    features, _ = split_xy(df)
    floats = set(columns_of(df, *FLOATS)) & set(features)
    return df.select(*[inf_to_nan(quoted(c)).alias(c) if c in floats else quoted(c) for c in df.columns])


def tag(df: DataFrame, **values) -> DataFrame:
    """Add constant key columns."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def map_labels(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Add ``<column>_label``: the display name of a code.

    Unknown codes get a title-cased name, or raise when ``strict``. The label
    table is a constant of this package, so it is broadcast.
    """
    table = label_table(df.sparkSession, column).select(
        F.col("code").alias(column), F.col("label").alias(f"{column}_label")
    )
    joined = df.join(F.broadcast(table), column, "left")
    code, label = F.col(column), F.col(f"{column}_label")
    fallback = (
        F.raise_error(F.concat(F.lit(f"no label for {column} "), code)).cast("string")
        if strict
        else title_case(code)
    )
    return joined.withColumn(f"{column}_label", F.coalesce(label, fallback))
