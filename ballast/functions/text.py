"""Number formatting for result tables, and digit extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_int(text: Column) -> Column:
    """First run of digits as a double; NULL where there is none."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("double")


def fixed4(x: Column) -> Column:
    """Four decimals, exact ties to even."""
    return F.format_string("%.4f", F.bround(x, 4))


def round_to_string(x: Column) -> Column:
    """Four decimals without trailing zeros, one digit kept after the point."""
    return F.when(x.isNotNull(), F.regexp_replace(fixed4(x), r"(\.\d+?)0+$", "$1"))


def format_mean_std(mean: Column, std: Column) -> Column:
    """``0.7108 (0.0058)``; a spread over one value prints as ``(n/a)``."""
    spread = F.when(std.isNull() | F.isnan(std), F.lit("n/a")).otherwise(fixed4(std))
    return F.when(mean.isNotNull(), F.concat(fixed4(mean), F.lit(" ("), spread, F.lit(")")))


def format_plus_minus(mean: Column, std: Column) -> Column:
    """``0.7108 ± 0.0058`` with trailing zeros dropped."""
    return F.concat(round_to_string(mean), F.lit(" ± "), F.coalesce(round_to_string(std), F.lit("n/a")))


def concat_label(*parts: Column) -> Column:
    return F.concat_ws(" / ", *parts)


def title_case(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))
