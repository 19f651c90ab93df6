"""Closing dates and time-left texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: a numeric date in running text.
DATE_IN_TEXT = r"\d{1,2}/\d{1,2}/\d{2,4}"


def end_date(text: Column) -> Column:
    """Timestamp of ``M/D/YYYY`` or ``M/D/YY`` text; NULL for anything else."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("M/d/yyyy")),
        F.try_to_timestamp(text, F.lit("M/d/yy")),
    )


def _units(text: Column, unit: str) -> Column:
    n = F.regexp_extract(text, rf"(?i)(\d+)\s*{unit}", 1).try_cast("int")
    return F.coalesce(n, F.lit(0))


def time_left_minutes(text: Column) -> Column:
    """Minutes of a time-left text; NULL if it names no number of days, hours or minutes."""
    total = _units(text, "day") * 1440 + _units(text, "h(?:ou)?r") * 60 + _units(text, "min")
    return F.when(text.rlike(r"(?i)\d+\s*(day|hour|hr|min)"), total)
