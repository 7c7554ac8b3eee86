"""Counting, flagging and linking events around the rows of a time grid."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.functions.timefn import floor_time, shift_seconds
from pitspark.operators.asof import DAY, asof_join, event_within, nearest_events
from pitspark.operators.chunked import SeriesKey, over_rows, row_positions

# Tells identical rows of a grid apart.
ROW = "__row"


def lag_time(df: DataFrame, key: SeriesKey, column: str, out: str) -> DataFrame:
    """Previous row's value of a column inside each series."""
    return over_rows(df, key, lambda d, w: d.withColumn(out, F.lag(column).over(w)), lookback=1)


def per_bar(df: DataFrame, *, time: str, seconds: int, aggs: Sequence[Column], out: str = "bar_close") -> DataFrame:
    """Aggregate rows into fixed buckets keyed by bucket end."""
    end = shift_seconds(floor_time(F.col(time), seconds), seconds)
    return df.groupBy(end.alias(out)).agg(*aggs)


def attach_shifted(left: DataFrame, agg: DataFrame, *, on: str, seconds: int, fill: Sequence[str]) -> DataFrame:
    """Left join an aggregate one step later in time; missing counts are 0."""
    later = agg.withColumn(on, shift_seconds(F.col(on), seconds))
    out = left.join(later, on, "left")
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in fill]
    return out.select(*left.columns, *filled)


def _numbered(events: DataFrame, time: str, tie: Sequence[str], chunk_seconds: int) -> DataFrame:
    key = SeriesKey((), time, tuple(tie), chunk_seconds)
    return row_positions(events.filter(F.col(time).isNotNull()), key, pos="__n")


def count_between(
    grid: DataFrame,
    events: DataFrame,
    *,
    key: SeriesKey,
    event_time: str,
    event_tie: Sequence[str],
    first_seconds: int,
    out: str,
    chunk_seconds: int = DAY,
) -> DataFrame:
    """Events in (previous grid time, grid time] per grid row.

    Events get running numbers; a row's count is the number seen at its time
    minus the number seen at the previous row (for the first row: at
    ``first_seconds`` before it). No event is paired with more than one bucket.
    """
    by, at = list(key.by), key.time
    numbered = _numbered(events, event_time, event_tie, chunk_seconds)
    opening = grid.groupBy(*by).agg(shift_seconds(F.min(at), -first_seconds).alias(at)).withColumn("__real", F.lit(False))
    points = grid.withColumn("__real", F.lit(True)).unionByName(opening, allowMissingColumns=True)
    seen = asof_join(
        points, numbered, left_time=at, right_time=event_time, strict=False, columns=["__n"], tie=["__n"],
        bucket_seconds=chunk_seconds,
    )

    def diff(d: DataFrame, w) -> DataFrame:
        n = F.coalesce(F.col("__n"), F.lit(0))
        return d.withColumn(out, n - F.coalesce(F.lag("__n").over(w), F.lit(0)))

    return over_rows(seen, key, diff, lookback=1).filter("__real").select(*grid.columns, out)


def lookback_slots(
    grid: DataFrame,
    events: DataFrame,
    *,
    by: Sequence[str],
    at: str,
    event_time: str,
    event_id: str,
    seconds: int,
    slots: int,
    chunk_seconds: int = DAY,
) -> DataFrame:
    """First ``slots`` events in [time - seconds, time) per grid row as an array.

    Event numbers turn the interval into a number range, so only the rows that
    fill a slot are ever joined.
    """
    numbered = _numbered(events, event_time, (event_id,), chunk_seconds)
    args = dict(
        right_time=event_time, strict=True, columns=["__n"], tie=["__n"], bucket_seconds=chunk_seconds
    )
    points = grid.withColumn(ROW, F.monotonically_increasing_id())
    lo = asof_join(
        points.withColumn("__from", shift_seconds(F.col(at), -seconds)), numbered, left_time="__from", prefix="__lo", **args
    )
    both = asof_join(lo, numbered, left_time=at, prefix="__hi", **args)
    start = F.coalesce(F.col("__lo__n"), F.lit(0)) + 1
    stop = F.least(start + slots - 1, F.coalesce(F.col("__hi__n"), F.lit(0)))
    wanted = F.when(stop >= start, F.sequence(start, stop))
    ranges = both.select(ROW, *grid.columns, F.explode_outer(wanted).alias("__n"))
    picked = ranges.join(numbered.select("__n", event_id), "__n", "left")
    collected = F.sort_array(F.collect_list(F.when(F.col(event_id).isNotNull(), F.struct("__n", event_id))))
    return (
        picked.groupBy(ROW)
        .agg(*[F.first(c).alias(c) for c in grid.columns], collected.alias("__s"))
        .select(*grid.columns, F.transform("__s", lambda s: s[event_id]).alias("slots"))
    )


def flags_within(
    grid: DataFrame,
    events: DataFrame,
    *,
    at: str,
    event_time: str,
    seconds: int,
    flags: Mapping[str, Column],
    bucket_seconds: int = 365 * DAY,
) -> DataFrame:
    """Per named event filter: is there an event within +- ``seconds``?

    The grid is exploded over the flag names and joined to its nearest events
    once, by flag; events are never paired with all rows in reach.
    """
    tagged = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in flags.items()]))
    long = events.select(F.explode(tagged).alias("__flag"), event_time)
    names = F.array(*[F.lit(n) for n in flags])
    points = grid.withColumn(ROW, F.monotonically_increasing_id()).select(ROW, *grid.columns, F.explode(names).alias("__flag"))
    near = nearest_events(
        points, long, left_time=at, event_time=event_time, by=["__flag"], bucket_seconds=bucket_seconds
    )
    hit = event_within(F.col("prev_event"), F.col("next_event"), F.col(at), seconds)
    return near.groupBy(ROW).agg(
        *[F.first(c).alias(c) for c in grid.columns],
        *[F.coalesce(F.bool_or(F.when(F.col("__flag") == n, hit)), F.lit(False)).alias(n) for n in flags],
    ).drop(ROW)


def legs_on_date(
    df: DataFrame,
    *,
    legs: Mapping[str, str],
    series: str,
    formulas: Mapping[str, Callable[[dict[str, Column]], Column]],
    date: str = "date",
    value: str = "value",
    visible: str = "t_visible",
) -> DataFrame:
    """Combine series observed on the same date, visible when the last leg is.

    One grouped pass instead of a chain of self joins; dates where a leg is
    missing are dropped (inner-join semantics).
    """
    src = df.filter(F.col(series).isin(list(legs.values())) & F.col(value).isNotNull())
    aggs: list[Column] = []
    for n, sid in legs.items():
        aggs.append(F.max(F.when(F.col(series) == sid, F.col(value))).alias(f"__{n}"))
    wide = src.groupBy(date).agg(F.max(visible).alias(visible), *aggs)
    wide = wide.dropna(subset=[f"__{n}" for n in legs])
    cols = {n: F.col(f"__{n}") for n in legs}
    return wide.select(date, visible, *[f(cols).alias(o) for o, f in formulas.items()])


def trailing_count(
    df: DataFrame, *, by: Sequence[str], time: str, tie: Sequence[str], seconds: int, out: str, bucket_seconds: int = DAY
) -> DataFrame:
    """Rows of the same key in (time - seconds, time], counted from running
    numbers at both ends of the range instead of a window over the range."""
    numbered = row_positions(df, SeriesKey(tuple(by), time, tuple(tie), bucket_seconds), pos="__n")
    args = dict(right_time="__rt", strict=False, columns=["__n"], by=list(by), tie=["__n"], bucket_seconds=bucket_seconds)
    right = numbered.select(*by, F.col(time).alias("__rt"), "__n")
    now = asof_join(df.withColumn("__from", shift_seconds(F.col(time), -seconds)), right, left_time=time, prefix="__hi", **args)
    then = asof_join(now, right, left_time="__from", prefix="__lo", **args)
    count = F.col("__hi__n") - F.coalesce(F.col("__lo__n"), F.lit(0))
    return then.select(*df.columns, count.alias(out))
