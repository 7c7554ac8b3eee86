"""Contracts and data-quality checks; every check is one aggregate job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_alignment(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of keys present on one side only or on both."""
    both = (
        left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(*keys)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    counts = both.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("left_only"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("right_only"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("both"),
    )
    return counts.unpivot([], ["left_only", "right_only", "both"], "side", "n")


def irregular_gap(date, w, *, lo_days: int = 6, hi_days: int = 8):
    """True when the distance to the previous row is outside the usual range;
    the first row is never flagged. Takes the window of ``over_rows``."""
    gap = F.date_diff(date, F.lag(date).over(w))
    return F.coalesce((gap > hi_days) | (gap < lo_days), F.lit(False))


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def late_release(df: DataFrame, release: str = "release_ts", visible: str = "t_visible") -> DataFrame:
    """Rows that claim to be visible before they were released."""
    return df.filter(F.col(release) > F.col(visible))


def lookahead_counts(df: DataFrame, day: str, columns: Sequence[str]) -> DataFrame:
    """(column, n) rows whose visibility lies after the row's day."""
    counts = df.agg(*[F.count_if(F.col(c) > F.col(day)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "n")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def degenerate_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_values, all_null, constant) from one pass."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs.append(F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(c))
    one = df.agg(*aggs)
    long = one.unpivot([], list(columns), "column", "s")
    return long.select(
        "column",
        F.col("s.n").alias("n_values"),
        (F.col("s.n") == 0).alias("all_null"),
        F.coalesce(F.col("s.lo") == F.col("s.hi"), F.lit(False)).alias("constant"),
    )


def missing_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys without any row; the actual side is only deduplicated by
    the join itself."""
    return expected.select(*keys).join(actual.select(*keys), list(keys), "left_anti")


def non_monotonic(df: DataFrame, key, time: str, chunk=None) -> DataFrame:
    """Rows whose time is not after the time of the row before them, in the
    arrival order given by the key; adds ``prev_ts``."""
    from pitspark.operators.chunked import over_rows

    out = over_rows(df, key, lambda d, w: d.withColumn("prev_ts", F.lag(time).over(w)), lookback=1, chunk=chunk)
    return out.filter(F.col("prev_ts") >= F.col(time))


def missing_slots(rows: DataFrame, *, by: str, time: str, seconds: int) -> DataFrame:
    """Grid slots between a series' first and last row that have no row."""
    ends = rows.groupBy(by).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    step = F.expr(f"interval {seconds} seconds")
    grid = ends.select(by, F.explode(F.sequence("lo", "hi", step)).alias(time))
    return missing_keys(grid, rows, [by, time])
