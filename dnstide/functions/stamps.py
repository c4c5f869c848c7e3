"""Stamps: 14 digits, year to second, compared as text."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "yyyyMMddHHmmss"
LONG_RANGE = timedelta(days=5)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, FORMAT)


def time_of(c: Column) -> Column:
    return F.to_timestamp(c, FORMAT)


def whole_point(c: Column) -> Column:
    """The stamp floored to five minutes."""
    minute = F.substring(c, 11, 2).cast("int")
    return F.concat(F.substring(c, 1, 10), F.lpad((minute - minute % 5).cast("string"), 2, "0"), F.lit("00"))


def bound(text: str) -> datetime:
    """A range bound; days and hours may run over or be 0, as ``20130900`` for the last of August."""
    y, m, *rest = (int(text[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14)))
    d, h, mi, s = rest
    return datetime(y + (m - 1) // 12, (m - 1) % 12 + 1, 1) + timedelta(days=d - 1, hours=h, minutes=mi, seconds=s)


def is_long(start: str, end: str) -> bool:
    """Is the range five days or more, so that the one-day tables answer it?"""
    return bound(end) - bound(start) >= LONG_RANGE
