"""Analytic views (bars, vintages, articles, scores, ...) over the base tables.

Each view is lazy; nothing is collected and nothing is cached.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.functions.mathfn import cosine, rnd
from pitspark.functions.timefn import floor_time, shift_seconds
from pitspark.operators.chunked import SeriesKey
from pitspark.operators.lookups import attach_lookup
from pitspark.operators.versions import order_key
from pitspark.session import prepare

HOUR = 3600
DAY = 86_400

BAR = SeriesKey(by=("symbol",), time="bar_close", chunk_seconds=7 * DAY)
DAILY = SeriesKey(by=("symbol",), time="bar_close", chunk_seconds=365 * DAY)

def ohlcv(ticks: DataFrame, *, seconds: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Open/high/low/close/volume bars from ticks (ts, event_id, price).

    Partial hash aggregates run before the shuffle, so a bar of any size costs
    one row per map task. A bar is released, and visible, at its end.
    """
    order = order_key(F.col("ts"), F.col("event_id"))
    return (
        ticks.groupBy(*by, floor_time(F.col("ts"), seconds).alias("bar_open"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.count(F.lit(1)).alias("volume"),
            F.avg("price").alias("vwap"),
        )
        .withColumn("bar_close", shift_seconds(F.col("bar_open"), seconds))
        .withColumn("release_ts", F.col("bar_close"))
        .withColumn("t_visible", F.col("bar_close"))
    )


@dataclass(frozen=True)
class Tables:
    """The base tables of one directory and the views over them."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        prepare(self.spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def ticks(self) -> DataFrame:
        return self.read("events").select(
            "ts", "event_id", F.col("event_type").alias("symbol"), F.col("value").alias("price")
        )

    @cached_property
    def bars(self) -> DataFrame:
        """Hourly bars per symbol."""
        return ohlcv(self.ticks, seconds=HOUR)

    @cached_property
    def bars30(self) -> DataFrame:
        """Half-hour bars per symbol."""
        return ohlcv(self.ticks, seconds=HOUR // 2)

    @cached_property
    def daily(self) -> DataFrame:
        """Daily bars per series over seven years."""
        day = F.date_trunc("day", F.col("o_orderdate")).cast("timestamp_ntz")
        return (
            self.read("orders")
            .groupBy(F.col("o_orderpriority").alias("symbol"), day.alias("bar_open"))
            .agg(
                F.min_by("o_totalprice", "o_orderkey").alias("open"),
                F.max("o_totalprice").alias("high"),
                F.min("o_totalprice").alias("low"),
                F.max_by("o_totalprice", "o_orderkey").alias("close"),
                F.count(F.lit(1)).alias("volume"),
                (F.count_if(F.col("o_orderstatus") == "P") > 0).alias("news"),
            )
            .withColumn("bar_close", shift_seconds(F.col("bar_open"), DAY))
            .withColumn("t_visible", F.col("bar_close"))
        )

    @cached_property
    def vintages(self) -> DataFrame:
        """Revisioned series: one value per (series, date, realtime_start)."""
        li = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
        od = self.read("orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
        start = F.col("o_orderdate") + F.make_dt_interval(F.col("l_linenumber"))
        return (
            od.join(li, od.o_orderkey == li.l_orderkey)
            .groupBy(
                F.col("o_orderpriority").alias("series_id"),
                F.col("o_orderdate").alias("date"),
                start.alias("realtime_start"),
            )
            .agg(rnd(F.avg("l_extendedprice"), 8).alias("value"))
            .withColumn("release_ts", F.col("realtime_start"))
            .withColumn("t_visible", F.col("realtime_start"))
        )

    @cached_property
    def articles(self) -> DataFrame:
        minutes = F.pmod(F.col("doc_id") * 7919, F.lit(43_200)).cast("int")
        epoch = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        created = epoch + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
        return (
            self.read("documents")
            .select(
                F.col("doc_id").alias("article_id"),
                "source",
                "lang",
                F.col("text").alias("body"),
                created.alias("created_at"),
            )
            .withColumn("release_ts", F.col("created_at"))
            .withColumn("t_visible", shift_seconds(F.col("created_at"), 60))
        )

    @cached_property
    def article_times(self) -> DataFrame:
        """Articles without their text, for joins on time only."""
        return self.articles.select("article_id", "source", "lang", "created_at", "t_visible")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("article_id"),
            F.col("label").cast("long").alias("label"),
            F.col("embedding").cast("array<double>").alias("vec"),
        )

    @cached_property
    def anchors(self) -> DataFrame:
        from pitspark.operators.vectors import anchor_vectors

        return anchor_vectors(self.vectors, by="label", vec="vec")

    @cached_property
    def scores(self) -> DataFrame:
        """Classifier scores: logit of class c is 10 x cosine to anchor c."""
        rows = attach_lookup(self.vectors, self.anchors, "anchors")
        logit = F.transform("anchors", lambda a: rnd(cosine(F.col("vec"), a["anchor"]) * 10.0))
        return rows.select(
            F.col("article_id").alias("row_id"),
            "label",
            F.transform("anchors", lambda a: a["label"]).alias("classes"),
            logit.alias("logits"),
            F.pmod(F.floor(F.col("article_id") / 2), F.lit(2)).cast("long").alias("fold"),
            F.when(F.pmod(F.floor(F.col("article_id") / 4), F.lit(2)) == 0, "b")
            .otherwise("c")
            .alias("slice"),
            (F.pmod(F.col("article_id"), F.lit(2)) == 1).alias("present"),
        )

    @cached_property
    def schedule(self) -> DataFrame:
        """Macro release schedule over the years the tables span."""
        from pitspark.operators.calendars import event_schedule

        return event_schedule(self.read("orders"), "o_orderdate", self.read("events"), "ts")

    @cached_property
    def positions_book(self) -> DataFrame:
        month = F.trunc("l_shipdate", "month").cast("timestamp_ntz")
        qty = F.col("l_quantity")
        flag = F.col("l_returnflag")
        return (
            self.read("lineitem")
            .groupBy(F.col("l_suppkey").alias("contract"), month.alias("report_date"))
            .agg(
                F.sum(F.when(flag == "A", qty).otherwise(0.0)).alias("longs"),
                F.sum(F.when(flag == "R", qty).otherwise(0.0)).alias("shorts"),
                F.sum(qty).alias("total"),
            )
        )

