"""Dates: parsing, buckets, differences, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyworks.functions.numbers import col

# Accepted layouts, in order of preference.
FEED_FORMATS = ("dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")
PAGE_FORMATS = (
    "dd-MMM-yyyy HH:mm",
    "dd-MMM-yyyy hh:mm a",
    "dd-MM-yyyy HH:mm",
    "dd/MM/yyyy HH:mm",
    "dd-MMM-yyyy",
    "dd/MM/yyyy",
    "yyyy-MM-dd",
)


def parse_date(c: str | Column, formats: Sequence[str] = FEED_FORMATS) -> Column:
    """First layout that fits, else null (DAT-01)."""
    t = F.trim(col(c))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]).cast("date")


def month(c: str | Column, layout: str = "yyyy-MM") -> Column:
    """Month bucket as text (DAT-02)."""
    return F.date_format(col(c), layout)


def whole_days(start: str | Column, end: str | Column) -> Column:
    """Rounded days from start to end; never negative, 0 if one is missing (DAT-03)."""
    secs = col(end).cast("timestamp").cast("double") - col(start).cast("timestamp").cast("double")
    return F.coalesce(F.greatest(F.floor(secs / 86400.0 + 0.5), F.lit(0)), F.lit(0)).cast("long")


def is_weekend(c: str | Column) -> Column:
    """Saturday or Sunday (DAT-04)."""
    return F.weekday(col(c)) >= 5


def day_range(first: str | Column, last: str | Column) -> Column:
    """Array of the days from first to last, both included (DAT-05)."""
    return F.sequence(col(first), col(last), F.expr("interval 1 day"))


def horizon(last: str | Column, days: int) -> Column:
    """Array of the ``days`` days after ``last`` (DAT-05)."""
    return F.sequence(F.date_add(col(last), 1), F.date_add(col(last), days), F.expr("interval 1 day"))


def days_back(as_of: Column, days: int) -> Column:
    return F.date_sub(as_of, days)
