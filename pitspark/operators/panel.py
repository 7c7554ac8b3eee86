"""Daily panels of many sparse series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.operators.asof import asof_join

DAY = 86_400


def daily_grid(df: DataFrame, time: str, out: str = "day") -> DataFrame:
    """Every calendar day between the first and the last value of a column."""
    lo, hi = (F.to_date(f(F.col(time))) for f in (F.min, F.max))
    days = df.agg(F.sequence(lo, hi, F.expr("interval 1 day")).alias("d"))
    return days.select(F.explode("d").alias("d")).select(F.col("d").cast("timestamp_ntz").alias(out))


def asof_panel(
    days: DataFrame,
    long: DataFrame,
    *,
    day: str,
    series: str,
    value: str,
    visible: str,
    tie: Sequence[str],
    names: Mapping[str, str],
    strict: bool = False,
    bucket_seconds: int = 365 * DAY,
) -> DataFrame:
    """Wide panel (day, visible, one column per series).

    The grid is exploded over the declared series and joined as-of once by
    (series, time), whatever the number of series; each series is carried
    forward on its own visibility.
    """
    wanted = F.array(*[F.lit(n) for n in names])
    # numbered before it is exploded: the id tells identical days apart
    grid = days.withColumn("__row", F.monotonically_increasing_id()).select("__row", day, F.explode(wanted).alias(series))
    src = long.filter(F.col(value).isNotNull() & F.col(series).isin(list(names)))
    joined = asof_join(
        grid,
        src,
        left_time=day,
        right_time=visible,
        strict=strict,
        columns=[value],
        by=[series],
        tie=tie,
        matched_time="__seen",
        bucket_seconds=bucket_seconds,
    )
    cells = [F.max(F.when(F.col(series) == k, F.col(value))).alias(c) for k, c in names.items()]
    return joined.groupBy("__row").agg(F.first(day).alias(day), F.max("__seen").alias(visible), *cells).drop("__row")
