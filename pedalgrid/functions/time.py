"""Trip hours and epoch timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _in_day(h: Column) -> Column:
    return F.when(h.between(0, 23), h.cast("int"))


def trip_hour(c: Column) -> Column:
    """Hour 0-23 of a start time that comes in one of three forms.

    A full (sentinel-dated) timestamp, a fraction of a day, or the bare hour;
    the first reading that works wins.
    """
    text = c.cast("string")
    num = text.try_cast("double")
    stamp = F.hour(F.try_to_timestamp(text)).cast("double")
    fraction = F.when((num >= 0) & (num < 1), F.rint(num * 24))
    bare = F.when(num.between(0, 23), F.rint(num))
    return _in_day(F.coalesce(stamp, fraction, bare))


def valid_hour(c: Column) -> Column:
    """Already normalised hour, bounded to 0-23."""
    num = c.cast("string").try_cast("double")
    return F.when(num.between(0, 23), F.rint(num).cast("int"))


def from_epoch_ms(c: Column) -> Column:
    return F.timestamp_millis(c.cast("string").try_cast("double").try_cast("bigint"))


def iso_day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
