"""Voting-day clock: epoch milliseconds to day, local hour and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# UTC midnights (epoch seconds) that bound voting days 12 and 13.
DAY_STARTS = (1775952000, 1776038400, 1776124800)
DAY_LABELS = (12, 13)
# Fixed value: local time is five hours behind UTC all year.
UTC_OFFSET_HOURS = -5


def seconds(ms: Column) -> Column:
    return F.floor(ms / F.lit(1000)).cast("long")


def voting_day(ms: Column, day_starts: tuple[int, ...] = DAY_STARTS,
               labels: tuple[int, ...] = DAY_LABELS) -> Column:
    """Label of the UTC voting day an instant falls in, 0 for any other."""
    s = seconds(ms)
    day = F.lit(0)
    for label, lo, hi in zip(labels, day_starts, day_starts[1:]):
        day = F.when((s >= lo) & (s < hi), label).otherwise(day)
    return day


def local_hour(ms: Column, offset_hours: int = UTC_OFFSET_HOURS) -> Column:
    s = seconds(ms) + F.lit(offset_hours * 3600)
    return F.coalesce(F.floor(F.pmod(s, F.lit(86400)) / 3600).cast("int"), F.lit(-1))


def local_text(ms: Column, offset_hours: int = UTC_OFFSET_HOURS) -> Column:
    s = seconds(ms) + F.lit(offset_hours * 3600)
    return F.date_format(F.timestamp_seconds(s), "dd/MM/yyyy HH:mm:ss")
