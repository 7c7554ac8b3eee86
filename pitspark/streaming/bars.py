"""Streaming bars, deduplication and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.functions.timefn import shift_seconds


def stream_bars(ticks: DataFrame, *, seconds: int, lateness: str, by: str = "symbol") -> DataFrame:
    """OHLCV bars from a tick stream (symbol, ts, event_id, price).

    In append mode a bar is emitted once the watermark passes its end, which is
    also the moment it becomes visible.
    """
    order = F.struct("ts", "event_id")
    agg = (
        ticks.withWatermark("ts", lateness)
        .groupBy(by, F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )
    cols = ("open", "high", "low", "close", "volume")
    return agg.select(by, F.col("w.start").alias("bar_open"), F.col("w.end").alias("bar_close"), *cols)


def dedupe_articles(articles: DataFrame, *, key: str = "article_id", time: str = "created_at", lateness: str = "1 day") -> DataFrame:
    """Each article once; repeats within the lateness bound are dropped and the
    source offsets of the query replace a hand-kept cursor."""
    return articles.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def articles_per_bar(articles: DataFrame, *, seconds: int, lateness: str, latency_seconds: int = 60) -> DataFrame:
    """Articles per bar by the time they became visible.

    A late article counts in the bar its visibility falls into; rows behind the
    watermark are dropped and reported as ``numRowsDroppedByWatermark``. Bars
    are right-inclusive, so the window is taken just before the visible time.
    """
    seen = articles.withColumn("t_visible", shift_seconds(F.col("created_at"), latency_seconds))
    inside = seen.withColumn("__at", F.col("t_visible") - F.expr("interval 1 microsecond"))
    return (
        inside.withWatermark("__at", lateness)
        .groupBy(F.window("__at", f"{seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("news_count"))
        .select(F.col("w.end").alias("bar_close"), "news_count")
    )
