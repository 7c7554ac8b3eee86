"""Regime thresholds fitted on training rows and applied everywhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.functions.sessions import year_buckets
from pitspark.operators.chain import filtered, fit_chains
from pitspark.operators.chunked import SeriesKey
from pitspark.operators.ranks import exact_quantiles


def fit_terciles(train: DataFrame, by: Sequence[str], value: str, *, min_rows: int = 3, prefix: str = "") -> DataFrame:
    """Exact (1/3, 2/3) cuts per group; NULL where there are too few rows."""
    name = prefix or value
    q = exact_quantiles(train, by, value, {f"{name}_t1": 1 / 3, f"{name}_t2": 2 / 3})
    enough = F.col("n_values") >= min_rows
    return q.select(*by, *[F.when(enough, F.col(f"{name}_{t}")).alias(f"{name}_{t}") for t in ("t1", "t2")])


def tercile_flags(value: Column, t1: Column, t2: Column) -> tuple[Column, Column, Column]:
    """One-hot low / mid / high; all zero for missing values or cuts."""
    valid = value.isNotNull() & t1.isNotNull() & t2.isNotNull()
    low, mid = value <= t1, (value > t1) & (value <= t2)
    high = value > t2
    return tuple(F.coalesce(valid & c, F.lit(False)).cast("long") for c in (low, mid, high))


def regime_columns(
    df: DataFrame, thresholds: DataFrame, by: Sequence[str], *, levels: Mapping[str, str], event_week: Column, time: Column
) -> DataFrame:
    """Eleven flags: terciles of each level, event week, year bucket. The
    threshold table has one row per group."""
    out = df.join(thresholds, list(by), "left")
    for name, col in levels.items():
        low, mid, high = tercile_flags(F.col(col), F.col(f"{name}_t1"), F.col(f"{name}_t2"))
        out = (
            out.withColumn(f"regime_{name}_low", low)
            .withColumn(f"regime_{name}_mid", mid)
            .withColumn(f"regime_{name}_high", high)
        )
    out = out.withColumn("regime_event_week", F.coalesce(event_week.cast("long"), F.lit(0)).cast("long"))
    for n, c in year_buckets(time).items():
        out = out.withColumn(f"regime_year_{n}", c)
    return out.drop(*[f"{n}_{t}" for n in levels for t in ("t1", "t2")])


def volatility_posterior(
    df: DataFrame, *, fold: str, key: SeriesKey, train: Column, ret: str, rv: str, out: str, min_rows: int = 200, turns: int = 10
) -> DataFrame:
    """Probability of the high-volatility state of a two-state chain on
    (|return|, realised vol), fitted on each fold's training rows.

    The filter sees the rows up to each row only, so nothing later changes it.
    Rows with a missing feature, and rows of folds with fewer than ``min_rows``
    training rows, get 0.5. ``turns`` is the number of EM steps.
    """
    rows = df.withColumn("__a", F.abs(F.col(ret)))
    chains = fit_chains(rows, fold, key, ["__a", rv], train, turns=turns, min_rows=min_rows)
    return filtered(rows, fold, key, ["__a", rv], chains, out).drop("__a")
