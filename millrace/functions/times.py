"""Dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    """ISO-8601 with microseconds and offset."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def date_text(ts: Column) -> Column:
    """Like ``Jan 5, 03:04 PM``; ``--`` for null."""
    return F.coalesce(F.date_format(ts, "MMM d, hh:mm a"), F.lit("--"))


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "h:mm:ss a")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, rounded half up, at least 0."""
    ms = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(ms / 1000 + 0.5)).cast("bigint")


def duration_text(start: Column, end: Column, now: Column) -> Column:
    """``Ns`` under a minute, else ``Mm Ss``; ``--`` without a start; a missing end is ``now``."""
    s = seconds_between(start, F.coalesce(end, now))
    minutes = F.floor(s / 60)
    text = F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
    return F.when(start.isNull(), "--").otherwise(text)
