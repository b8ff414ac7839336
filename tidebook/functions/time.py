"""Time functions over unix seconds. All of them are UTC and independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.functions.numbers import as_column

RESOLUTIONS = ("second", "minute", "hour", "day", "month")
_WIDTH = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def time_bucket(time_unix: Column | str, resolution: str = "minute", offset: Column | int = 0) -> Column:
    """Start of the bucket that holds a time; bucket edges are moved forward by ``offset`` seconds.

    An unknown resolution falls back to minutes.
    """
    time = F.col(time_unix) if isinstance(time_unix, str) else time_unix
    shift = as_column(offset).cast("long")
    shifted = time.cast("long") - shift
    if resolution == "month":
        day = F.date_from_unix_date(F.floor(shifted / 86400).cast("int"))
        return F.unix_date(F.trunc(day, "month")).cast("long") * 86400 + shift
    width = _WIDTH.get(resolution, _WIDTH["minute"])
    return shifted - F.pmod(shifted, F.lit(width).cast("long")) + shift


def day_offset(before: Column | int) -> Column:
    """Seconds from the start of the day."""
    return F.pmod(as_column(before).cast("long"), F.lit(86400).cast("long"))


def floor_to_minute(time_unix: Column | int) -> Column:
    return time_bucket(as_column(time_unix), "minute")


def floor_to_day(time_unix: Column | int) -> Column:
    return time_bucket(as_column(time_unix), "day")


def iso_to_unix(iso: Column | str) -> Column:
    """ISO time to whole seconds: read to the millisecond, then rounded half up."""
    text = F.col(iso) if isinstance(iso, str) else iso
    return F.floor(F.unix_millis(F.to_timestamp(text)) / 1000 + 0.5).cast("long")
