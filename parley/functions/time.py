"""P6 time roll-up expressions (local wall clock in a configured zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local(ts: Column | str, tz: str) -> Column:
    """UTC instant -> wall clock in `tz` (TIMESTAMP without meaning of zone)."""
    return F.from_utc_timestamp(_c(ts), tz)


def hour(ts: Column | str) -> Column:
    return F.hour(_c(ts)).cast("int")


def isodow(ts: Column | str) -> Column:
    """ISO weekday, Monday = 1 .. Sunday = 7."""
    return (F.weekday(_c(ts)) + 1).cast("int")


def month(ts: Column | str) -> Column:
    """'yyyy-MM' label of the month."""
    return F.date_format(_c(ts), "yyyy-MM")


def week_start(ts: Column | str) -> Column:
    """'yyyy-MM-dd' of the Monday that starts the week."""
    return F.date_format(F.date_trunc("week", _c(ts)), "yyyy-MM-dd")


def day(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd")


def epoch_seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """(later - earlier) in fractional seconds, DOUBLE."""
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / F.lit(1e6)
