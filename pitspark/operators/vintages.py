"""Revisioned series as they were known at many instants at once.

Two times matter: the date an observation is about, and when a value of it became
known. Swept along knowledge time, "the latest observation" moves from date to
date; each date is the latest, or the k-th before the latest, during one interval.
A revision takes effect where its own time meets that interval, so every vintage
row becomes at most one change for each k, and rows look these changes up by an
as-of join. Nothing is paired with all dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.functions.timefn import from_micros, micros
from pitspark.operators.asof import asof_join
from pitspark.operators.chunked import Running, SeriesKey, over_rows, running


def known_changes(vintages: DataFrame, by: Sequence[str], *, date: str = "date", start: str = "realtime_start", value: str = "value", lags: Sequence[int] = (0,), chunk_seconds: int = 365 * 86_400) -> DataFrame:
    """(by, lag, at, known, start, obs, value): from ``at`` on, the observation ``lag`` dates before the latest known date is
    the one of ``obs``, with this value (``known`` 0 and NULL: not known yet). Of equal ``at`` the highest (known, start) counts."""
    by = list(by)
    dates = vintages.filter(F.col(date).isNotNull() & F.col(start).isNotNull()).groupBy(*by, date).agg(F.min(start).alias("__first"))
    # a date is surpassed as soon as a later one is known, whatever the order of the releases
    back = dates.withColumn("__back", from_micros(-micros(F.col(date))))
    dates = running(back, SeriesKey(tuple(by), "__back", (), chunk_seconds), [Running("__known", "min", F.col("__first"))]).select(*by, date, "__known")

    def compute(d, w):
        at = lambda k: F.lead("__known", k).over(w) if k else F.col("__known")
        return d.withColumns({f"__on{k}": at(k) for k in lags} | {f"__off{k}": at(k + 1) for k in lags})

    dates = over_rows(dates, SeriesKey(tuple(by), date, (), chunk_seconds), compute, lookback=0, lookahead=max(lags) + 1)
    spans = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__on{k}").alias("on"), F.col(f"__off{k}").alias("off")) for k in lags])).alias("__span")
    spans = dates.select(*by, date, spans).filter(F.col("__span.on").isNotNull() & (F.col("__span.off").isNull() | (F.col("__span.on") < F.col("__span.off"))))
    spans = spans.select(F.struct(*by, date).alias("__k"), "__span.*")  # null keys are equal inside a struct
    own = vintages.filter(F.col(start).isNotNull()).select(F.struct(*by, date).alias("__k"), F.col(start).alias("start"), F.col(value).alias("value"))
    values = own.join(spans, "__k").filter(F.col("off").isNull() | (F.col("start") < F.col("off")))
    values = values.select("__k", "lag", F.greatest("start", "on").alias("at"), F.lit(1).alias("known"), "start", "value")
    open_ = spans.select("__k", "lag", F.col("on").alias("at"), F.lit(0).alias("known"), F.col("on").alias("start"), F.lit(None).cast(vintages.schema[value].dataType).alias("value"))
    out = values.unionByName(open_)
    return out.select(*[F.col(f"__k.{c}").alias(c) for c in by], "lag", "at", "known", "start", F.col(f"__k.{date}").alias("obs"), "value")


def as_known_at_rows(
    left: DataFrame, vintages: DataFrame, *, left_time: str, by: Sequence[str], date: str = "date", start: str = "realtime_start", value: str = "value", lags: Sequence[int] = (0,),
    bucket_seconds: int = 90 * 86_400,
) -> DataFrame:
    """Add ``obs_k`` and ``value_k`` for each k of ``lags``: of the series as known at each row's time (inclusive), the
    observation k dates before the latest one; its value is NULL while it is not known.
    As in every as-of join, a null key matches nothing."""
    changes = known_changes(vintages, by, date=date, start=start, value=value, lags=lags)
    out = left
    for k in lags:
        some = changes.filter(F.col("lag") == k).select(*by, "at", "known", F.col("start").alias("since"), F.col("obs").alias(f"obs_{k}"), F.col("value").alias(f"value_{k}"))
        out = asof_join(
            out, some, left_time=left_time, right_time="at", strict=False, columns=[f"obs_{k}", f"value_{k}"], by=list(by), tie=["known", "since"], bucket_seconds=bucket_seconds
        )
    return out
