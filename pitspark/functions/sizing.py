"""Position sizing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitspark.functions.mathfn import BARS_PER_YEAR, sqrt_impact_cost

TARGET_VOL, VOL_CAP, FLOOR, EPS = 0.15, 3.0, 0.40, 1e-8


def _limit(x: Column, bound: float) -> Column:
    return F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))


def vol_target(var: Column, *, target: float = TARGET_VOL, bars_per_year: int = BARS_PER_YEAR, cap: float = VOL_CAP) -> Column:
    """Multiplier that brings a per-bar variance to the target volatility."""
    vol = F.sqrt(F.greatest(var, F.lit(0.0)) * bars_per_year)
    m = F.lit(target) / F.greatest(vol, F.lit(EPS))
    return F.when(var.isNotNull(), F.least(m, F.lit(cap)))


def kelly(edge: Column, var: Column, cost: Column | float = 0.0, *, fraction: float = 0.4, limit: float = 1.0, eps: float = 1e-6) -> Column:
    """Fractional Kelly size net of friction; no size without variance or when
    the edge does not pay the cost."""
    c = F.lit(float(cost)) if isinstance(cost, (int, float)) else cost
    raw = F.when(var > 0, F.lit(fraction) * edge / F.when(var > 0, var)).otherwise(0.0)
    size = F.abs(edge)
    friction = F.when(size > eps, F.greatest(F.lit(0.0), 1 - c / F.when(size > eps, size))).otherwise(0.0)
    return F.when(edge.isNotNull() & var.isNotNull(), _limit(raw * friction, limit))


def confidence_floor(size: Column, lower_bound: Column, threshold: float = FLOOR) -> Column:
    ok = F.coalesce((lower_bound >= threshold) & ~F.isnan(lower_bound), F.lit(False))
    return F.when(ok, size).otherwise(0.0)


def size_position(
    edge: Column, lower_bound: Column, posterior_var: Column, realized_var: Column, prev: Column, *, stage: int = 2, limit: float = 1.0
) -> Column:
    """Stage 1: volatility target only. Stage 2: Kelly net of impact cost, times
    the volatility multiplier, behind the confidence floor."""
    mult = vol_target(realized_var)
    if stage == 1:
        return _limit(edge * mult, limit)
    cost = sqrt_impact_cost(F.abs(edge - prev))
    sized = kelly(edge, realized_var + posterior_var, cost) * mult
    return _limit(confidence_floor(sized, lower_bound), limit)
