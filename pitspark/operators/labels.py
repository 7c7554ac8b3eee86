"""Forward-looking labels and their thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitspark.functions.mathfn import ratio


def atr_barrier(atr: Column, close: Column, mult: float = 0.25) -> Column:
    """Positive log-return threshold; NULL for non-positive closes."""
    return F.when(close > 0, F.lit(float(mult)) * ratio(atr, close))


def fixed_label(next_return: Column, threshold_bps: float = 5.0) -> Column:
    """2 / 0 / 1 for a next return above / below / within the threshold."""
    limit = F.lit(threshold_bps / 10_000.0)
    label = F.when(next_return > limit, 2).when(next_return < -limit, 0).otherwise(1)
    return F.when(next_return.isNotNull(), label).cast("long")


def triple_barrier_label(next_return: Column, up: Column, down: Column, spread_bps: Column) -> Column:
    """+1 / -1 when a barrier is reached by a move wider than the spread, else
    0; rows with a missing or non-positive input are 0."""
    inside = F.abs(next_return) < spread_bps / F.lit(10_000.0)
    valid = next_return.isNotNull() & spread_bps.isNotNull() & (up > 0) & (down > 0)
    fired = F.when(inside, 0).when(next_return >= up, 1).when(next_return <= -down, -1).otherwise(0)
    # A move through both barriers cannot happen: they have opposite signs.
    return F.when(F.coalesce(valid, F.lit(False)), fired).otherwise(0).cast("long")


def to_class_index(label: Column) -> Column:
    return (label + 1).cast("long")


def calendar_split(ts: Column, train_end: str, val_end: str) -> Column:
    """train <= train_end < val <= val_end < test."""
    t1, t2 = (F.lit(s).cast("timestamp_ntz") for s in (train_end, val_end))
    return F.when(ts > t2, "test").when(ts > t1, "val").otherwise("train")
