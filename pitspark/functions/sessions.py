"""Position of a time inside the exchange session and the calendar."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from pitspark.functions.timefn import minute_of_day, to_exchange

OPEN, CLOSE = 570, 960  # 09:30 and 16:00 local


def session_phase(bar_start: Column) -> Column:
    """0 open, 1 midday, 2 afternoon, 3 close, -1 outside the session."""
    m = minute_of_day(to_exchange(bar_start))
    return (
        F.when((m < OPEN) | (m >= CLOSE), -1).when(m < 660, 0).when(m < 840, 1).when(m < 930, 2).otherwise(3).cast("long")
    )


def session_bar_index(bar_start: Column) -> Column:
    """Half-hour bar number 0..12 since the open, -1 outside."""
    i = F.floor((minute_of_day(to_exchange(bar_start)) - OPEN) / 30)
    return F.when(i.between(0, 12), i).otherwise(-1).cast("long")


def session_date(ts: Column) -> Column:
    return F.to_date(to_exchange(ts))


def is_last_of_session(bar_start: Column, w: WindowSpec) -> Column:
    """True on the last bar of each session (and of the series)."""
    nxt = F.lead(session_date(bar_start)).over(w)
    return nxt.isNull() | (nxt != session_date(bar_start))


def era_label(ts: Column) -> Column:
    y = F.year(ts)
    return F.when(y <= 2019, 0).when(y <= 2022, 1).when(y <= 2024, 2).otherwise(3).cast("long")


def year_buckets(ts: Column) -> dict[str, Column]:
    y = F.year(ts)
    flags = {
        "2016_2019": y.between(2016, 2019),
        "2020_2022": y.between(2020, 2022),
        "2023_2024": y.between(2023, 2024),
        "2025_plus": y >= 2025,
    }
    return {n: c.cast("long") for n, c in flags.items()}


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def is_third_friday(day: Column) -> Column:
    return (F.dayofweek(day) == 6) & F.dayofmonth(day).between(15, 21)


def is_quarter_end_window(day: Column, days: int = 3) -> Column:
    """One of the last ``days`` calendar days of a quarter."""
    end = F.last_day(day)
    return F.month(day).isin(3, 6, 9, 12) & (F.date_diff(end, day) < days)
