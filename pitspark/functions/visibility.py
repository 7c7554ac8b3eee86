"""When a row becomes public: one rule per kind of source.

All times are UTC wall times; exchange-local rules use the zone database.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitspark.functions.fixed import DEFAULT_SETTLEMENT_MINUTE, RELEASE_MINUTE, SETTLEMENT_MINUTE
from pitspark.functions.timefn import at_minute, from_exchange, shift_seconds
from pitspark.operators.calendars import next_session

NOON = 12 * 60
OPEN_MINUTE = 9 * 60 + 30
CLOSE_MINUTE = 16 * 60


def _lookup(key: Column, table: Mapping[str, int]) -> Column:
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*entries), key)


def bar_end(start: Column, minutes: int = 30) -> Column:
    return shift_seconds(start, minutes * 60)


def after_latency(created: Column, seconds: int = 60) -> Column:
    return shift_seconds(created, seconds)


def publish_or_partition(published: Column, partition: Column, buffer_minutes: int = 30) -> Column:
    return F.greatest(shift_seconds(published, buffer_minutes * 60), partition)


def release_time_of_day(day: Column, series: Column, table: Mapping[str, int] = RELEASE_MINUTE) -> Column:
    """Day of the revision at the series' local release time; NULL for series
    without a release time (they must be added to the table)."""
    return from_exchange(at_minute(F.to_date(day), _lookup(series, table)))


def weekly_report(report_day: Column, days: int = 3) -> Column:
    """Session close on the Friday after a Tuesday report, or the next session."""
    return from_exchange(at_minute(next_session(F.date_add(F.to_date(report_day), days)), CLOSE_MINUTE))


def monthly_index(month: Column, day: int = 7) -> Column:
    nxt = F.add_months(F.trunc(month, "month"), 1)
    return at_minute(F.date_add(nxt, day - 1), NOON)


def day_lag(observed: Column, days: int = 30) -> Column:
    return at_minute(F.date_add(F.to_date(observed), days), NOON)


def first_business_day(period: Column, months: int = 2) -> Column:
    first = F.add_months(F.trunc(period, "month"), months)
    dow = F.dayofweek(first)
    rolled = F.when(dow == 7, F.date_add(first, 2)).when(dow == 1, F.date_add(first, 1)).otherwise(first)
    return at_minute(rolled, NOON)


def next_open(day: Column) -> Column:
    return from_exchange(at_minute(F.date_add(F.to_date(day), 1), OPEN_MINUTE))


def settlement(day: Column, ticker: Column, table: Mapping[str, int] = SETTLEMENT_MINUTE) -> Column:
    minute = F.coalesce(_lookup(ticker, table), F.lit(DEFAULT_SETTLEMENT_MINUTE))
    return from_exchange(at_minute(F.to_date(day), minute))


def announced_ahead(event: Column, days: int = 365) -> Column:
    return shift_seconds(event, -days * 86_400)
