"""Date and time expressions (D1-D14). The session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minute_boundaries(a: Column, b: Column) -> Column:
    """Minute marks crossed from ``a`` to ``b``; negative if ``b`` is earlier. Not the whole minutes elapsed."""
    return (F.unix_seconds(F.date_trunc("minute", b)) - F.unix_seconds(F.date_trunc("minute", a))) / F.lit(60)


def iso(ts: Column) -> Column:
    """ISO text with ``+00:00``; microseconds only where there are some."""
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(plain, F.when(F.unix_micros(ts) % 1_000_000 == 0, F.lit("")).otherwise(F.date_format(ts, ".SSSSSS")), F.lit("+00:00"))


def from_utc_text(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS UTC`` to a timestamp, null where it is none."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss 'UTC'"))


def coerce_utc(text: Column) -> Column:
    """ISO text to a timestamp; without a zone it is read as UTC."""
    return F.try_to_timestamp(text)


def inferred_fetch(day: Column) -> Column:
    """Two in the morning after the day that was collected."""
    return F.timestamp_add("HOUR", F.lit(2), F.date_add(day, 1).cast("timestamp"))


def collection_day(fetched: Column) -> Column:
    return F.date_sub(F.to_date(fetched), 1)


def freshness(latest: Column, now: Column, hours: int = 3) -> Column:
    return F.when(F.unix_seconds(now) - F.unix_seconds(latest) < hours * 3600, "Current").otherwise("Delayed")


def this_month(at: Column, now: Column) -> Column:
    """Whether ``at`` lies in the month of ``now``."""
    return F.date_trunc("month", at) == F.date_trunc("month", now)


def default_day(now: Column) -> Column:
    """The day before ``now``: the last one that is over."""
    return F.date_sub(F.to_date(now), 1)
