"""Time arithmetic on zone-less timestamps.

The engine keeps ``timestamp_ntz`` values that mean UTC. Exchange-local rules
go through ``convert_timezone`` so daylight saving is applied by the zone
database, never by a fixed offset.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCHANGE_ZONE = "America/New_York"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (session zone must be UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def shift_seconds(ts: Column, seconds: int) -> Column:
    return ts + F.expr(f"interval {int(seconds)} seconds")


def floor_time(ts: Column, seconds: int) -> Column:
    """Start of the fixed-width bucket a time falls in."""
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(seconds * 1_000_000)))


def time_chunk(ts: Column, seconds: int) -> Column:
    """Integer bucket number, non-decreasing in time: used to cut long series."""
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def to_exchange(ts: Column) -> Column:
    """UTC wall time -> exchange-local wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(EXCHANGE_ZONE), ts)


def from_exchange(ts: Column) -> Column:
    """Exchange-local wall time -> UTC wall time."""
    return F.convert_timezone(F.lit(EXCHANGE_ZONE), F.lit("UTC"), ts)


def at_minute(day: Column, minute: Column | int) -> Column:
    """Wall time on a date at a minute of the day."""
    m = F.lit(minute) if isinstance(minute, int) else minute
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)
