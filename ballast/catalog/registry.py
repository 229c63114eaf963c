"""The table of registered queries and helpers to state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, the SQL that must give the same rows."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating point columns to a fixed number of decimals, so that two engines can be compared."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name)
            if isinstance(f.dataType, kinds)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def r6(expression: str, alias: str) -> str:
    """The SQL counterpart of :func:`rounded` for one column."""
    return f"round(cast({expression} as double), 6) as {alias}"


def long_form(df: DataFrame, **keys: str) -> DataFrame:
    """``(keys, column_name, value)`` of every cell: numbers in ten-thousandths, everything else as its text."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns]
    cell = df.select(*[F.lit(v).alias(k) for k, v in keys.items()], F.explode(F.array(*cells)).alias("cell"))
    number = F.expr("try_cast(cell.value as double)")
    whole = F.abs(number) < 1e14  # false for what is infinite or not a number
    value = F.when(number.isNotNull() & whole, F.floor(number * 10000 + 0.5).cast("string")).otherwise(F.lower("cell.value"))
    return cell.select(*keys, "cell.column_name", value.alias("value"))


def long_counts(df: DataFrame, **keys: str) -> DataFrame:
    """``(keys, column_name, n, present)``: for every column the cells it has in :func:`long_form` and those that hold a value.

    A cell there is missing exactly where the column is, so all columns are counted in one pass over the rows and
    only the counts are laid out, one row a column.
    """
    columns = list(enumerate(df.columns))
    counted = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in columns])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col("n"), F.col(f"c{i}").alias("present")) for i, c in columns]
    return counted.select(*[F.lit(v).alias(k) for k, v in keys.items()], F.inline(F.array(*cells))).where("n > 0")


def long_sql(sql: str, **keys: str) -> str:
    """The SQL counterpart of :func:`long_form`."""
    named = "".join(f"'{v}' as {k}, " for k, v in keys.items())
    number = "try_cast(cell as double)"
    value = f"case when abs({number}) < 1e14 then cast(cast(floor({number} * 10000 + 0.5) as bigint) as varchar) else lower(cell) end"
    return (
        f"select {named}column_name, {value} as value"
        f" from (select columns(*)::varchar from ({sql})) unpivot include nulls (cell for column_name in (columns(*)))"
    )
