"""Month texts and day differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean days in a month.
DAYS_PER_MONTH = 30.4375


def parse_month(text: Column) -> Column:
    """``Mar-2016`` as the first day of that month; anything else is NULL."""
    return F.to_date(F.try_to_timestamp(text, F.lit("MMM-yyyy")))


def months_between_days(later: Column, earlier: Column) -> Column:
    """Elapsed days in units of the mean month."""
    return F.datediff(later, earlier) / F.lit(DAYS_PER_MONTH)
