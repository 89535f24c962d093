"""Clock arithmetic on TIMESTAMP_NTZ columns that does not depend on the session time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(value: Column | datetime | str) -> Column:
    """A cutoff given as a column, a datetime or an ISO string, as a TIMESTAMP_NTZ column."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def days(n: int) -> Column:
    return F.expr(f"interval {int(n)} days")


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    gap = later - earlier
    part = lambda unit: F.extract(F.lit(unit), gap).cast("double")
    return part("DAY") * 86400.0 + part("HOUR") * 3600.0 + part("MINUTE") * 60.0 + part("SECOND")


def elapsed_days(later: Column, earlier: Column) -> Column:
    return elapsed_seconds(later, earlier) / F.lit(86400.0)


def day_start(column: Column) -> Column:
    return column.cast("date").cast("timestamp_ntz")


def month_start(column: Column) -> Column:
    return F.trunc(column.cast("date"), "month").cast("timestamp_ntz")


def quarter_start(column: Column) -> Column:
    return F.trunc(column.cast("date"), "quarter").cast("timestamp_ntz")


def stamp(column: Column) -> Column:
    """Readable text form of a timestamp."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
