"""Rule strategies: DataFrame -> DataFrame adding a ``position`` column.

A strategy gets bars keyed by a :class:`SeriesKey` (add ``fold`` to the key to
restart it per fold) and returns them with positions in [-1, 1].
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.functions.mathfn import clip, ratio
from pitspark.operators import boosting
from pitspark.operators import rolling as R
from pitspark.operators.asof import asof_join
from pitspark.operators.chunked import POS, Ewm, Running, SeriesKey, ewm_block, over_rows, running, with_ewm

Strategy = Callable[[DataFrame, SeriesKey], DataFrame]
POSITION = "position"
C = F.col
MISSING = -1e30


def buy_hold() -> Strategy:
    return lambda df, key: df.withColumn(POSITION, F.lit(1.0))


def ma_cross(fast: int = 50, slow: int = 200, *, flat_below: bool = False, warmup: int | None = None) -> Strategy:
    """Sign of fast minus slow exponential average, acting one bar later; the
    first ``warmup`` bars (default: the slow span) stay flat."""
    warm = slow if warmup is None else warmup
    a, b = 2 / (fast + 1), 2 / (slow + 1)
    below = 0.0 if flat_below else -1.0

    def run(df: DataFrame, key: SeriesKey) -> DataFrame:
        def compute(d, w):
            d = with_ewm(d, w, {"__fast": Ewm(C("close"), a), "__slow": Ewm(C("close"), b)})
            d = d.withColumn("__raw", F.when(C("__fast") > C("__slow"), 1.0).otherwise(below))
            held = F.coalesce(F.lag("__raw").over(w), F.lit(0.0))
            return d.withColumn(POSITION, F.when(C(POS) > warm, held).otherwise(0.0)).drop("__raw", "__fast", "__slow")

        return over_rows(df, key, compute, lookback=1, block_rows=min(ewm_block(a), ewm_block(b)))

    return run


def donchian(window: int = 20, *, high: str = "close", low: str = "close") -> Strategy:
    """+1 / -1 on a close outside the prior channel, held until the next break."""

    def run(df: DataFrame, key: SeriesKey) -> DataFrame:
        def compute(d, w):
            hi, lo = R.channel(C(high), C(low), window, w)
            return d.withColumn("__sig", F.when(C("close") > hi, 1.0).when(C("close") < lo, -1.0))

        sig = over_rows(df, key, compute, lookback=window)
        held = running(sig, key, [Running("__held", "last", C("__sig"))])
        return held.withColumn(POSITION, F.coalesce("__held", F.lit(0.0))).drop("__sig", "__held")

    return run


def session_rule(signal: Column, *, high_vol: Column | None = None, last_bar: Column | None = None) -> Strategy:
    """Sign of the session-bar return, optionally only in high volatility and
    only on the last bar of the session."""
    pos = F.coalesce(F.signum(signal), F.lit(0.0))
    for mask in (high_vol, last_bar):
        if mask is not None:
            pos = F.when(F.coalesce(mask, F.lit(False)), pos).otherwise(0.0)
    return lambda df, key: df.withColumn(POSITION, pos)


def daily_fill(
    last_bar: str,
    *,
    trend_fast: int = 5,
    trend_slow: int = 20,
    momentum: int = 5,
    vol_target: float = 0.01,
    atr_window: int = 14,
    max_position: float = 1.0,
) -> Strategy:
    """Session-close signal (trend agreeing with momentum, sized by range) that
    applies to all bars after that close."""
    a, b, g = 2 / (trend_fast + 1), 2 / (trend_slow + 1), 1 / atr_window
    reach = max(momentum, atr_window) + 1
    block = min(ewm_block(x, reach) for x in (a, b, g))
    need = max(trend_slow, momentum, atr_window) + 1

    def run(df: DataFrame, key: SeriesKey) -> DataFrame:
        by = list(key.by)
        closes = df.filter(C(last_bar)).select(*by, *key.order, "close")

        def compute(d, w):
            step = F.abs(C("close") - F.coalesce(F.lag("close").over(w), C("close")))
            d = d.withColumn("__step", step)
            upto = F.avg("__step").over(w.rowsBetween(-(atr_window - 1), 0))
            d = d.withColumn("__seeded", F.when(C(POS) == atr_window, upto).otherwise(C("__step")))
            d = with_ewm(d, w, {"__atr": Ewm(C("__seeded"), g, atr_window), "__fast": Ewm(C("close"), a), "__slow": Ewm(C("close"), b)})
            atr = F.when(C(POS) < atr_window, upto).otherwise(C("__atr"))
            trend = F.signum(C("__fast") - C("__slow"))
            mom = F.coalesce(F.signum(ratio(C("close"), F.lag("close", momentum).over(w)) - 1), F.lit(0.0))
            rel = ratio(atr, C("close"))
            size = F.when(rel > 0, clip(F.lit(vol_target) / rel, 0.0, max_position)).otherwise(0.0)
            return d.withColumn("__set", F.when(trend == mom, trend).otherwise(0.0) * size)

        signal = over_rows(closes, key, compute, lookback=reach, block_rows=block)
        enough = closes.groupBy(*by).agg((F.count(F.lit(1)) >= need).alias("__enough"))
        timed = signal.select(*by, C(key.time).alias("__at"), "__set")
        out = asof_join(
            df, timed, left_time=key.time, right_time="__at", strict=True, columns=["__set"], by=by,
            bucket_seconds=key.chunk_seconds,
        ).join(enough, by, "left")
        pos = F.when(F.coalesce(C("__enough"), F.lit(False)), F.coalesce("__set", F.lit(0.0))).otherwise(0.0)
        return out.withColumn(POSITION, pos).drop("__set", "__enough")

    return run


def gated(weight: Column, lower_bound: Column, floor: float = 0.40) -> Column:
    """Model weight kept only where the score's lower bound reaches the floor."""
    return F.when(lower_bound >= floor, weight).otherwise(F.lit(0.0))


def run_strategies(df: DataFrame, key: SeriesKey, strategies: Mapping[str, Strategy], keep: list[str]) -> DataFrame:
    """Long table (strategy, keep..., position) of all strategies."""
    parts = [
        fn(df, key).select(F.lit(name).alias("strategy"), *keep, C(POSITION).cast("double").alias(POSITION))
        for name, fn in strategies.items()
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


def tree_positions(
    df: DataFrame, *, features: list[str], label: str, train: Column, out: str = POSITION, trees: int = 100, depth: int = 6, rate: float = 0.05
) -> DataFrame:
    """Boosted three-class trees on features; predicted class - 1 for every row.
    ``trees`` is the number of rounds. A missing feature is below all others.
    Zeros when the training rows hold fewer than two classes."""
    fit_rows = df.filter(train & C(label).isNotNull())
    if fit_rows.select(label).distinct().limit(2).count() < 2:
        return df.withColumn(out, F.lit(0.0))
    model = boosting.fit(fit_rows, features, C(label), rounds=trees, depth=depth, rate=rate)
    return boosting.with_class(df, features, model, out).withColumn(out, C(out) - 1.0)


def linear_positions(
    df: DataFrame, key: SeriesKey, *, train: Column, target: str, lookback: int = 16, trend_rows: int = 8, scale: float = 1.0, out: str = POSITION
) -> DataFrame:
    """Linear model on the trend and seasonal parts of the last ``lookback``
    returns, squashed by tanh, for every row; a missing input counts as 0. The
    moving average is causal."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    def compute(d, w):
        d = d.withColumn("__r", R.log_return(C("close"), 1, w))
        d = d.withColumn("__t", R.mean(C("__r"), trend_rows, trend_rows, w))
        d = d.withColumn("__s", C("__r") - C("__t"))
        for k in range(lookback):
            d = d.withColumn(f"__t{k}", F.lag("__t", k).over(w)).withColumn(f"__s{k}", F.lag("__s", k).over(w))
        return d

    cols = [f"__{p}{k}" for p in "ts" for k in range(lookback)]
    feats = over_rows(df, key, compute, lookback=lookback + trend_rows + 1)
    feats = feats.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})
    vec = VectorAssembler(inputCols=cols, outputCol="__x").transform(feats)
    fit_rows = vec.filter(train & C(target).isNotNull())
    model = LinearRegression(featuresCol="__x", labelCol=target, predictionCol="__p", regParam=1e-3).fit(fit_rows)
    return model.transform(vec).withColumn(out, F.tanh(C("__p") * scale)).select(*df.columns, out)
