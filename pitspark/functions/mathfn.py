"""Null-safe numeric expressions. NaN never enters the engine: divisions by
zero, logs of non-positive values and infinities become NULL (but see ``full_ln``)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BARS_PER_YEAR = 3276  # 252 sessions of 13 half-hour bars
EULER_GAMMA = 0.5772156649015329


def finite(c: Column) -> Column:
    """NULL for NaN and both infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def rnd(c: Column, places: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(c.cast("double"), places) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or missing."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def safe_ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c.cast("double")))


def full_ln(c: Column) -> Column:
    """Logarithm of every double: -inf for zero, NaN below; NULL for NULL alone."""
    d = c.cast("double")
    return F.when(d > 0, F.ln(d)).when(d == 0, F.lit(float("-inf"))).when(d < 0, F.lit(float("nan")))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value and keep NULL as NULL (least/greatest skip nulls)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def sqrt_impact_cost(delta_abs: Column, gamma: float = 0.02, k_bps: float = 0.7) -> Column:
    """Square-root market impact plus a linear part in basis points."""
    return F.lit(gamma) * F.sqrt(delta_abs) + F.lit(k_bps) * delta_abs / F.lit(10_000.0)


def linear_cost(bps: float):
    """Flat cost in basis points of traded weight, as a Column function."""
    return lambda delta_abs: F.lit(float(bps)) * delta_abs / F.lit(10_000.0)


def normal_quantile(p: float) -> float:
    """Standard normal quantile of a driver-side constant."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


# Fixed values of the published double-precision rational form (Hart 5666).
CDF_TOP = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_FAR = 7.07106781186547


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function to double precision (absolute error
    below 1e-14): a rational form, and a continued fraction in the far tail."""
    x = F.abs(z)

    def poly(coefs: tuple[float, ...]) -> Column:
        out = F.lit(coefs[0])
        for c in coefs[1:]:
            out = out * x + F.lit(c)
        return out

    tail = x + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = x + F.lit(k) / tail
    near = F.exp(-x * x / 2.0) * poly(CDF_TOP) / poly(CDF_BOTTOM)
    far = F.exp(-x * x / 2.0) / tail / F.lit(math.sqrt(2.0 * math.pi))
    upper = F.when(x < CDF_FAR, near).otherwise(far)
    return F.when(z >= 0, F.lit(1.0) - upper).otherwise(upper)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``; a plain
    Column used in a lambda would be evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(scores: Column, temperature: Column | float = 1.0) -> Column:
    """Softmax of an array of scores divided by a temperature."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature

    def shares(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda s: F.transform(exps, lambda x: x / s))

    def exps(scaled: Column) -> Column:
        return let(F.array_max(scaled), lambda m: let(F.transform(scaled, lambda x: F.exp(x - m)), shares))

    return let(F.transform(scores, lambda x: x / t), exps)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), l2_norm(a) * l2_norm(b))
