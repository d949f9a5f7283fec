"""Functions of times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def within_schedule(ts: Column, start: int, end: int) -> Column:
    """Whether the minute of the day is in [start, end), which may wrap around midnight."""
    m = minute_of_day(ts)
    return (m >= start) & (m < end) if start <= end else (m >= start) | (m < end)


def since(ts: Column, as_of: str, interval: str) -> Column:
    return (ts >= F.expr(f"timestamp '{as_of}' - interval {interval}")) & (ts < F.expr(f"timestamp '{as_of}'"))


def backoff(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
