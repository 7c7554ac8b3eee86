"""Choosing one version of a revisioned row, with map-side partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.functions.timefn import micros

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def order_key(time: Column, tie: Column) -> Column:
    """(time, integer tie-breaker) as one fixed-width number in the same order.

    Aggregates ordered by it keep fixed-width buffers and stay hash aggregates;
    ordering by a struct would make Spark sort all rows before aggregating.
    """
    wide = F.lit("20000000000000000000").cast("decimal(20,0)")
    return micros(time).cast("decimal(18,0)") * wide + tie.cast("decimal(19,0)")


def latest_by(
    df: DataFrame,
    keys: Sequence[str],
    *,
    order: Sequence[str],
    pick: Sequence[str] | None = None,
    first: bool = False,
) -> DataFrame:
    """One row per key: the one with the highest (or lowest) ``order``.

    With a single fixed-width order and fixed-width columns this is a hash
    aggregate; otherwise whole rows are compared (a sort aggregate).
    """
    cols = [c for c in (pick or df.columns) if c not in keys]
    choose = F.min_by if first else F.max_by
    used = {f.name: f.dataType for f in df.schema}
    if len(order) == 1 and all(isinstance(used[c], _FIXED) for c in [*cols, *order]):
        extreme = F.min if first else F.max
        by = F.col(order[0])
        return df.groupBy(*keys).agg(*[(extreme(by) if c == order[0] else choose(c, by)).alias(c) for c in cols])
    best = choose(F.struct(*cols), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*")


def as_known_at(
    vintages: DataFrame, keys: Sequence[str], *, at: str, version: str = "realtime_start",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """State of a revisioned table at an instant (inclusive)."""
    seen = vintages.filter(vintages[version] <= F.lit(at).cast("timestamp_ntz"))
    return latest_by(seen, keys, order=order or [version])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Deterministic drop-duplicates: keep the lowest ``order`` per key."""
    return latest_by(df, keys, order=order, first=True).select(*df.columns)
