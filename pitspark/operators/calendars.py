"""Event schedules and trading days generated by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.functions.fixed import RATE_DECISIONS, SPECIAL_CLOSURES
from pitspark.functions.timefn import at_minute, from_exchange, shift_seconds

YEAR_SECONDS = 365 * 86_400


def _roll_weekend_forward(d: Column) -> Column:
    day = F.dayofweek(d)  # 1 = Sunday, 7 = Saturday
    return F.when(day == 7, F.date_add(d, 2)).when(day == 1, F.date_add(d, 1)).otherwise(d)


def _roll_weekend_back(d: Column) -> Column:
    day = F.dayofweek(d)
    return F.when(day == 7, F.date_sub(d, 1)).when(day == 1, F.date_sub(d, 2)).otherwise(d)


def event_schedule(first: DataFrame, first_time: str, last: DataFrame | None = None, last_time: str | None = None) -> DataFrame:
    """Macro release schedule covering the years of the given tables:
    (event_type, event_ts, tier, release_ts, t_visible), times in UTC.

    One row per event, a few dozen per year. Schedules are public a year ahead.
    """
    times = first.select(F.col(first_time).alias("__t"))
    if last is not None:
        times = times.unionByName(last.select(F.col(last_time).alias("__t")))
    span = times.agg(F.min("__t").alias("lo"), F.max("__t").alias("hi"))
    y0, y1 = F.year("lo"), F.year("hi")
    months = span.select(
        F.explode(
            F.sequence(F.make_date(y0, F.lit(1), F.lit(1)), F.make_date(y1, F.lit(12), F.lit(1)), F.expr("interval 1 month"))
        ).alias("m")
    )
    m = F.col("m")
    end = F.last_day(m)
    quarter = F.month(m).isin(1, 4, 7, 10)

    def event(kind: str, day: Column, minute: int, tier: int) -> Column:
        return F.struct(
            F.lit(kind).alias("event_type"), day.alias("day"), F.lit(minute).alias("minute"), F.lit(tier).alias("tier")
        )

    ruled = [
        event("NFP", F.next_day(F.date_sub(m, 1), "Fri"), 510, 1),
        event("CPI", _roll_weekend_forward(F.date_add(m, 11)), 510, 1),
        event("JOLTS", _roll_weekend_forward(F.date_add(m, 8)), 600, 2),
        event("PCE", _roll_weekend_back(end), 510, 1),
        F.when(quarter, event("GDP", F.next_day(F.date_sub(end, 7), "Thu"), 510, 1)),
    ]
    decisions = F.array(
        *[F.lit(f"{y}-{mo:02d}-{d:02d}").cast("date") for y, days in RATE_DECISIONS.items() for mo, d in days]
    )
    this_month = F.filter(decisions, lambda d: F.trunc(d, "month") == m)
    meetings = F.flatten(
        F.transform(
            this_month,
            lambda d: F.array(event("FOMC", d, 840, 1), event("FOMC_minutes", F.date_add(d, 21), 840, 2)),
        )
    )
    rows = months.select(F.explode(F.concat(F.array_compact(F.array(*ruled)), meetings)).alias("e")).select("e.*")
    ts = from_exchange(at_minute(F.col("day"), F.col("minute")))
    return rows.select(
        "event_type",
        ts.alias("event_ts"),
        F.col("tier").cast("long").alias("tier"),
        shift_seconds(ts, -YEAR_SECONDS).alias("release_ts"),
        shift_seconds(ts, -YEAR_SECONDS).alias("t_visible"),
    )


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the century-corrected lunar rule."""
    def div(a: Column, b: int) -> Column:
        return F.floor(a / F.lit(b)).cast("int")

    golden = year % 19
    century = div(year, 100)
    epact = (century - div(century, 4) - div(F.lit(8) * century + 13, 25) + F.lit(19) * golden + 15) % 30
    full = epact - div(epact, 28) * (F.lit(1) - div(F.lit(29) / (epact + 1), 1) * div(F.lit(21) - golden, 11))
    weekday = (year + div(year, 4) + full + 2 - century + div(century, 4)) % 7
    offset = full - weekday
    month = F.lit(3) + div(offset + 40, 44)
    day = offset + 28 - F.lit(31) * div(month, 4)
    return F.make_date(year, month, day)


def _nth_weekday(year: Column, month: int, name: str, nth: int) -> Column:
    first = F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), name)
    return F.date_add(first, 7 * (nth - 1))


def _observed(day: Column, *, sunday_only: bool = False) -> Column:
    dow = F.dayofweek(day)
    moved = F.when(dow == 1, F.date_add(day, 1))
    if not sunday_only:
        moved = moved.when(dow == 7, F.date_sub(day, 1))
    return moved.otherwise(day)


def is_session(day: Column) -> Column:
    """True on regular exchange trading days (weekends and holidays excluded)."""
    y = F.year(day)
    fixed = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    memorial = F.next_day(F.date_sub(fixed(5, 31), 7), "Mon")
    holiday = (
        (day == _observed(fixed(1, 1), sunday_only=True))
        | ((y >= 1998) & (day == _nth_weekday(y, 1, "Mon", 3)))
        | (day == _nth_weekday(y, 2, "Mon", 3))
        | (day == F.date_sub(easter_sunday(y), 2))
        | (day == memorial)
        | ((y >= 2022) & (day == _observed(fixed(6, 19))))
        | (day == _observed(fixed(7, 4)))
        | (day == _nth_weekday(y, 9, "Mon", 1))
        | (day == _nth_weekday(y, 11, "Thu", 4))
        | (day == _observed(fixed(12, 25)))
        | day.isin([F.lit(s).cast("date") for s in SPECIAL_CLOSURES])
    )
    return F.dayofweek(day).between(2, 6) & ~holiday


def next_session(day: Column, within: int = 14) -> Column:
    """First trading day on or after a date."""
    days = F.sequence(day, F.date_add(day, within), F.expr("interval 1 day"))
    return F.get(F.filter(days, is_session), F.lit(0))
