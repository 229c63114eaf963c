"""Arithmetic with IEEE results where Spark's ANSI mode would raise or return NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def ieee_divide(a: Column, b: Column) -> Column:
    """``a / b`` as floating point hardware gives it: x/0 is an infinity, 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / b)


def ieee_log1p(x: Column) -> Column:
    """``log(1 + x)``: -inf at -1 and NaN below it, where the built-in gives NULL."""
    x = x.cast("double")
    return F.when(x == -1, F.lit(-INF)).when(x < -1, F.lit(NAN)).otherwise(F.log1p(x))


def inf_to_null(x: Column) -> Column:
    return F.when(F.abs(x) == INF, F.lit(None)).otherwise(x)


def inf_to_nan(x: Column) -> Column:
    return F.when(F.abs(x) == INF, F.lit(NAN)).otherwise(x)


def missing_to_null(x: Column) -> Column:
    """NULL and NaN both count as missing."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def fill_null_zero(x: Column) -> Column:
    """NULL becomes 0, NaN stays."""
    return F.coalesce(x, F.lit(0.0))


def fill_nan_zero(x: Column) -> Column:
    """NaN becomes 0, NULL stays."""
    return F.nanvl(x, F.lit(0.0))


def clamp_nonpositive(x: Column) -> Column:
    """Values at or below zero become 0; NULL stays NULL."""
    return F.when(x <= 0, F.lit(0)).otherwise(x)


def cast_sci_numeric(x: Column) -> Column:
    """Text such as ``1e+05`` as a double."""
    return x.cast("double")


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """A share that is 0 where its denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def cap_category(x: Column, highest: int) -> Column:
    """Codes above ``highest`` (and NULL) share the code ``highest + 1``, as text."""
    return F.when(x <= highest, x).otherwise(F.lit(highest + 1)).cast("int").cast("string")
