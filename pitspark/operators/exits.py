"""Exit rules over trades. A trade ends at its first exit, so a window over one
trade is bounded by the holding limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def atr_stop(
    df: DataFrame, *, trade: list[str], time: str, price: str = "price", atr: str = "atr", hard: float = 2.0, trail: float = 1.5
) -> DataFrame:
    """Per bar of a trade the stop level and whether it fires. Input rows carry
    entry_price, entry_atr and side (+1 / -1); a missing live range falls back
    to the one at entry."""
    w = Window.partitionBy(*trade).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    live = F.coalesce(C(atr), C("entry_atr"))
    long = C("side") > 0
    best = F.when(long, F.greatest(F.max(price).over(w), C("entry_price"))).otherwise(
        F.least(F.min(price).over(w), C("entry_price"))
    )
    d = df.withColumn("__best", best)
    hard_stop = C("entry_price") - C("side") * hard * C("entry_atr")
    trail_stop = C("__best") - C("side") * trail * live
    active = F.when(long, C("__best") > C("entry_price")).otherwise(C("__best") < C("entry_price"))
    both = F.when(long, F.greatest(hard_stop, trail_stop)).otherwise(F.least(hard_stop, trail_stop))
    stop = F.when(active, both).otherwise(hard_stop)
    fires = F.when(long, C(price) < stop).otherwise(C(price) > stop)
    return d.withColumn("stop", stop).withColumn("exit", fires).drop("__best")


def timeout(df: DataFrame, *, trade: list[str], time: str, max_bars: int = 390) -> DataFrame:
    """Bars held so far and whether the holding limit is reached."""
    w = Window.partitionBy(*trade).orderBy(time)
    held = F.row_number().over(w).cast("long")
    return df.withColumn("held", held).withColumn("exit", C("held") >= max_bars)


def first_exit(df: DataFrame, *, trade: list[str], time: str, price: str) -> DataFrame:
    """Exit time and price per trade; NULL while it is open."""
    at = F.when(C("exit"), C(time))
    return df.groupBy(*trade).agg(F.min(at).alias("exit_time"), F.min_by(price, at).alias("exit_price"))
