"""Column helpers for dates. Nothing here depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted spellings of a date, day first.
DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d")
# Spellings with a time of day.
TIME_FORMATS = ("yyyy-M-d H:m:s", "d/M/yyyy H:m:s")


def parse_date(column: Column, dtype: T.DataType) -> Column:
    """Date or timestamp columns pass; text is read day first; bad text is null."""
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return column
    if isinstance(dtype, T.TimestampType):
        return column.cast("timestamp_ntz")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    tries = [F.try_to_timestamp(column, F.lit(f)) for f in DATE_FORMATS + TIME_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def _has_time(column: Column, dtype: T.DataType) -> Column:
    """1 when the value lies after midnight, else 0."""
    if isinstance(dtype, T.DateType):
        return F.lit(0)
    return (column > column.cast("date").cast("timestamp_ntz")).cast("int")


def days_before(reference: str, column: Column, dtype: T.DataType) -> Column:
    """Whole days from ``column`` to the reference midnight, rounded down.

    A calendar difference would count noon of the day before as one day; it is zero.
    """
    parsed = parse_date(column, dtype)
    days = F.datediff(F.lit(reference).cast("date"), parsed.cast("date"))
    return days - _has_time(parsed, dtype)


def days_after(reference: str, column: Column, dtype: T.DataType) -> Column:
    """Whole days from the reference midnight to ``column``, rounded down."""
    parsed = parse_date(column, dtype)
    return F.datediff(parsed.cast("date"), F.lit(reference).cast("date"))
