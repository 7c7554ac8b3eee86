"""Backtests over one long table (strategy, fold, ..., bar)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions.mathfn import BARS_PER_YEAR, EULER_GAMMA, linear_cost, normal_cdf, normal_quantile, ratio
from pitspark.operators.chunked import Running, SeriesKey, over_rows, row_positions, running
from pitspark.operators.ranks import exact_quantiles
from pitspark.session import materialise

C = F.col
CostModel = Callable[[Column], Column]
# Draws of the bootstrap in a task, and rows of a table of prefix sums that is broadcast.
TASK_DRAWS, SMALL_TABLE = 250_000, 200_000
METRICS = ("sharpe", "sortino", "calmar", "max_drawdown", "hit_rate", "profit_factor", "expectancy")


def with_key(key: SeriesKey, *extra: str) -> SeriesKey:
    return SeriesKey((*key.by, *extra), key.time, key.tie, key.chunk_seconds)


def trades(df: DataFrame, key: SeriesKey, position: str = "position") -> DataFrame:
    """Add ``delta``: absolute change of the position, the first from flat."""

    def compute(d, w):
        prev = F.coalesce(F.lag(position).over(w), F.lit(0.0))
        return d.withColumn("delta", F.abs(C(position) - prev))

    return over_rows(df, key, compute, lookback=1)


def pnl(ret: Column, position: Column, delta: Column, cost: CostModel) -> Column:
    """Position times next return minus cost; a missing return earns nothing."""
    return position * F.coalesce(ret, F.lit(0.0)) - cost(delta)


def equity(df: DataFrame, key: SeriesKey, *, pnl_col: str = "pnl", initial: float = 1.0) -> DataFrame:
    """Add ``equity`` and its running ``peak``. Both prefixes use the same
    chunks, so the second one needs no further shuffle of the rows."""
    cum = running(df, key, [Running("__cum", "sum", C(pnl_col))], keep_chunk=True)
    top = running(cum, key, [Running("__top", "max", C("__cum"))])
    return (
        top.withColumn("equity", F.lit(initial) * F.exp("__cum"))
        .withColumn("peak", F.lit(initial) * F.exp("__top"))
        .drop("__cum", "__top")
    )


def backtest(
    df: DataFrame,
    key: SeriesKey,
    *,
    ret: str = "next_return",
    position: str = "position",
    cost: CostModel | None = None,
    initial: float = 1.0,
) -> DataFrame:
    """Adds delta, pnl, equity and peak per series of the key."""
    model = cost or linear_cost(2.0)
    t = trades(df, key, position)
    t = t.withColumn("pnl", pnl(C(ret), C(position), C("delta"), model))
    return equity(t, key, initial=initial)


def metrics(df: DataFrame, by: Sequence[str], *, pnl_col: str = "pnl", bars_per_year: int = BARS_PER_YEAR) -> DataFrame:
    """The metric bundle per group, in one aggregate with map-side partials.

    ``profit_factor`` is NULL when there are gains and no losses.
    """
    r = C(pnl_col)
    has_equity = "equity" in df.columns
    dd = (C("peak") - C("equity")) / F.greatest(C("peak"), F.lit(1e-12)) if has_equity else F.lit(0.0)
    a = df.groupBy(*by).agg(
        F.count(r).alias("n_bars"),
        F.avg(r).alias("__m"),
        F.stddev_samp(r).alias("__s"),
        F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0)))).alias("__d"),
        F.max(dd).alias("max_drawdown"),
        F.count_if(r != 0).alias("__nz"),
        F.count_if(r > 0).alias("__up"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("__gain"),
        F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("__loss"),
        F.avg(F.when(r != 0, r)).alias("__e"),
    )
    root = math.sqrt(bars_per_year)
    zero = F.lit(0.0)
    gain_only = (C("__loss") == 0) & (C("__gain") > 0)
    return a.select(
        *by,
        F.coalesce(ratio(C("__m"), C("__s")) * root, zero).alias("sharpe"),
        F.coalesce(ratio(C("__m"), C("__d")) * root, zero).alias("sortino"),
        F.coalesce(ratio(C("__m") * bars_per_year, C("max_drawdown")), zero).alias("calmar"),
        "max_drawdown",
        F.coalesce(ratio(C("__up"), C("__nz")), zero).alias("hit_rate"),
        F.when(~gain_only, F.coalesce(ratio(C("__gain"), C("__loss")), zero)).alias("profit_factor"),
        F.coalesce("__e", zero).alias("expectancy"),
        "n_bars",
    )


def cost_stress(
    df: DataFrame,
    key: SeriesKey,
    *,
    ret: str = "next_return",
    position: str = "position",
    base_bps: float = 2.0,
    multipliers: Sequence[float] = (0.5, 1.0, 1.5),
) -> DataFrame:
    """Metrics at several cost levels: trades are computed once, the rows are
    exploded over the multipliers and all curves run in one job."""
    t = trades(df, key, position)
    m = t.withColumn("multiplier", F.explode(F.array(*[F.lit(float(x)) for x in multipliers])))
    cost = C("multiplier") * base_bps * C("delta") / 10_000.0
    m = m.withColumn("pnl", C(position) * F.coalesce(C(ret), F.lit(0.0)) - cost)
    curves = equity(m, with_key(key, "multiplier"))
    return metrics(curves, [*key.by, "multiplier"])


def bucket_metrics(df: DataFrame, key: SeriesKey, *, present: Column, pnl_col: str = "pnl") -> DataFrame:
    """Metrics for rows with and without news and for both; every bucket has its
    own equity curve. Empty buckets give zeros."""
    own = F.when(F.coalesce(present, F.lit(False)), "present").otherwise("absent")
    b = df.drop("equity", "peak").withColumn("bucket", F.explode(F.array(own, F.lit("both"))))
    m = metrics(equity(b, with_key(key, "bucket"), pnl_col=pnl_col), [*key.by, "bucket"], pnl_col=pnl_col)
    groups = df.groupBy(*key.by).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    grid = groups.withColumn("bucket", F.explode(F.array(*[F.lit(x) for x in ("present", "absent", "both")])))
    filled = grid.join(m, [*key.by, "bucket"], "left")
    empty = C("n_bars").isNull()
    zeros = [F.when(empty, F.lit(0.0)).otherwise(C(c)).alias(c) for c in METRICS]
    return filled.select(*key.by, "bucket", *zeros, F.coalesce("n_bars", F.lit(0)).alias("n_bars"))


def deflated_sharpe(sharpe: Column, n_obs: Column, n_trials: int, *, skew: Column | float = 0.0, kurt: Column | float = 3.0) -> tuple[Column, Column]:
    """(p value, sharpe minus the expected best of ``n_trials`` random ones)."""
    n = max(2, n_trials)
    best = (1 - EULER_GAMMA) * normal_quantile(1 - 1 / n) + EULER_GAMMA * normal_quantile(1 - 1 / (n * math.e))
    sk = F.lit(float(skew)) if isinstance(skew, (int, float)) else skew
    ku = F.lit(float(kurt)) if isinstance(kurt, (int, float)) else kurt
    denom = F.sqrt(F.greatest(F.lit(1e-12), 1 - sk * sharpe + (ku - 1) / 4 * sharpe * sharpe))
    z = (sharpe - best) * F.sqrt(F.greatest(F.lit(0.0), n_obs - F.lit(1.0))) / denom
    few = n_obs <= 1
    return F.when(few, 0.0).otherwise(normal_cdf(z)), F.when(few, 0.0).otherwise(sharpe - best)


def monotone(stress: DataFrame, by: Sequence[str], *, tol: float = 1e-6, gate: float = 0.5, at: float = 1.5) -> DataFrame:
    """Per group: does Sharpe fall as cost rises, and is it above the gate?
    Windows run over the handful of cost levels of a group."""
    w = Window.partitionBy(*by).orderBy("multiplier")
    s = stress.withColumn("__prev", F.lag("sharpe").over(w))
    ok = F.coalesce(C("sharpe") <= C("__prev") + tol, F.lit(True))
    passed = F.max(F.when(C("multiplier") == at, C("sharpe") > gate))
    return s.groupBy(*by).agg(F.bool_and(ok).alias("monotone"), F.coalesce(passed, F.lit(False)).alias("passes_gate"))


def walk_forward(
    df: DataFrame, key: SeriesKey, *, present: Column, n_trials: int, base_bps: float = 2.0, multipliers: Sequence[float] = (0.5, 1.0, 1.5)
) -> DataFrame:
    """Every strategy and fold at every (multiplier, bucket): one long result.

    Buckets are evaluated at the base cost, stress levels on all rows; rows are
    exploded once over the five combinations.
    """
    t = trades(df, key)
    own = F.when(F.coalesce(present, F.lit(False)), "present").otherwise("absent")
    combos = F.array(
        *[F.struct(F.lit(float(m)).alias("multiplier"), F.lit("both").alias("bucket")) for m in multipliers],
        F.struct(F.lit(1.0).alias("multiplier"), own.alias("bucket")),
    )
    m = t.withColumn("__c", F.explode(combos)).select("*", "__c.*").drop("__c")
    m = m.withColumn("pnl", pnl(C("next_return"), C("position"), C("delta"), lambda d: C("multiplier") * base_bps * d / 10_000.0))
    by = [*key.by, "multiplier", "bucket"]
    out = metrics(equity(m, with_key(key, "multiplier", "bucket")), by)
    p, value = deflated_sharpe(C("sharpe"), C("n_bars"), n_trials)
    base = (C("multiplier") == 1.0) & (C("bucket") == "both")
    return out.withColumn("dsr_p", F.when(base, p)).withColumn("dsr", F.when(base, value))


def promotion_gates(results: DataFrame, *, model: str, fold: Sequence[str], margin: float = 0.2, need_wins: int = 3) -> DataFrame:
    """Gate table (gate, value, threshold, pass) from walk-forward results;
    gates that need other evidence have NULL value and pass."""
    both = C("bucket") == "both"
    is_model = C("strategy") == model
    per_fold = results.groupBy(*fold).agg(
        F.max(F.when(is_model & both & (C("multiplier") == 1.0), C("sharpe"))).alias("m1"),
        F.max(F.when(is_model & both & (C("multiplier") == 1.5), C("sharpe"))).alias("m15"),
        F.max(F.when(~is_model & both & (C("multiplier") == 1.0), C("sharpe"))).alias("best"),
        F.max(F.when(is_model & both, C("dsr"))).alias("dsr"),
        F.max(F.when(is_model & (C("bucket") == "present"), C("sharpe"))).alias("present"),
        F.max(F.when(is_model & (C("bucket") == "absent"), C("sharpe"))).alias("absent"),
    )
    split = F.coalesce((C("present") > 0) & (C("absent") > 0), F.lit(False))
    a = per_fold.agg(
        F.avg("m1").alias("g1"),
        F.avg("m15").alias("g2"),
        F.count_if(C("m1") - C("best") >= margin).cast("double").alias("g3"),
        F.min("dsr").alias("g7"),
        F.count_if(split).cast("double").alias("g8"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )
    none = F.lit(None)

    def gate(name: str, value: Column, threshold: Column, ok: Column) -> Column:
        return F.struct(
            F.lit(name).alias("gate"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold"), ok.cast("boolean").alias("passed")
        )

    return a.select(
        F.explode(
            F.array(
                gate("1_sharpe_1x", C("g1"), F.lit(1.0), C("g1") > 1.0),
                gate("2_sharpe_1_5x", C("g2"), F.lit(0.5), C("g2") > 0.5),
                gate("3_beats_baseline", C("g3"), F.lit(float(need_wins)), C("g3") >= need_wins),
                gate("4_coverage", none, none, none),
                gate("5_sizer_stage", none, none, none),
                gate("6_breaker_regimes", none, none, none),
                gate("7_dsr", C("g7"), F.lit(1.0), C("g7") > 1.0),
                gate("8_bucket_positive", C("g8"), C("n"), C("g8") == C("n")),
            )
        ).alias("g")
    ).select("g.*")


def trade_stats(df: DataFrame, by: Sequence[str], bars_per_year: int = BARS_PER_YEAR) -> DataFrame:
    """Turnover (annualised), number of trades and compounded return of log returns."""
    return df.groupBy(*by).agg(
        (F.sum("delta") * bars_per_year / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("turnover"),
        F.count_if(C("delta") != 0).alias("trade_count"),
        F.expm1(F.sum("pnl")).alias("total_return"),
    )


def bootstrap_sharpe(
    df: DataFrame,
    key: SeriesKey,
    *,
    pnl_col: str = "pnl",
    replicates: int = 5000,
    block: int | None = None,
    level: float = 0.95,
    seed: int = 17,
    bars_per_year: int = BARS_PER_YEAR,
) -> DataFrame:
    """Stationary block bootstrap interval of the Sharpe ratio per series.

    A replicate is a list of blocks (random start, geometric length); a block's
    sum and sum of squares are differences of prefix sums, looked up by row
    number. Draws come from seeded hashes, so a retried task repeats them.

    A replicate's draws are one row of two arrays, spread over tasks of about
    ``TASK_DRAWS`` draws, and are cut to the length of the series where they lie.
    Prefix sums of at most ``SMALL_TABLE`` rows in all go to the draws, larger
    tables meet them in a shuffle: replicates x blocks rows, never resampled returns.
    """
    by = list(key.by)
    series = F.struct(*by).alias("__series")  # null keys are equal inside a struct
    size = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(pnl_col).alias("__t1"), F.sum(C(pnl_col) * C(pnl_col)).alias("__t2")
    )
    mean_len = F.lit(float(block)) if block else F.greatest(F.lit(1.0), F.floor(F.cbrt(C("__n").cast("double"))))
    size = size.withColumn("__len", mean_len)
    expected = C("__n") / C("__len")
    # Enough draws that a replicate falls short of its length once in 1e12.
    size = size.withColumn("__blocks", F.ceil(expected + 8 * F.sqrt(expected) + 16).cast("int"))
    size = materialise(size.withColumn("__id", F.monotonically_increasing_id()))
    n_rows, n_draws = size.agg(F.sum("__n"), F.sum(C("__blocks").cast("long")) * replicates).first()

    pos = row_positions(df, key, pos="__i")
    pre = running(pos, key, [Running("__s1", "sum", C(pnl_col)), Running("__s2", "sum", C(pnl_col) * C(pnl_col))])
    table = pre.select("*", series).join(size.select(series, "__id"), "__series").select("__id", "__i", "__s1", "__s2")

    def hashed(tag: str) -> Column:
        return F.transform(F.sequence(F.lit(1), C("__blocks")), lambda k: F.xxhash64(*by, "__b", k, F.lit(tag), F.lit(seed)))

    reps = size.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("__b"))
    reps = reps.repartition(max(1, -(-(n_draws or 0) // TASK_DRAWS)), "__id", "__b")
    draws = reps.select("__id", "__b", "__n", "__len", hashed("start").alias("__start"), hashed("len").alias("__want"))

    def block_ends(batches):
        """Of each replicate's draws, the blocks up to the length of the series: a block is whole laps and the difference of
        the prefixes at its two ends. Blocks wrap around the end."""
        for b in batches:
            many = pc.list_value_length(b.column("__start")).to_numpy().astype(np.int64)
            row, behind = np.repeat(np.arange(len(b)), many), np.cumsum(many)
            start, want = ((np.mod(b.column(c).flatten().to_numpy(), 1 << 52) + 0.5) / (1 << 52) for c in ("__start", "__want"))
            n, mean_len = b.column("__n").to_numpy(), b.column("__len").to_numpy()
            single = mean_len <= 1
            decay = np.log(1 - 1 / np.where(single, 2.0, mean_len))
            want = np.where(single[row], 1.0, np.maximum(np.ceil(np.log(want) / decay[row]), 1.0)).astype(np.int64)
            start = np.floor(start * n[row]).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(want)))
            left = n[row] - (upto[:-1] - upto[behind - many][row])
            take = np.minimum(want, left)
            take[behind - 1] = left[behind - 1]
            # Blocks are taken until the length is reached.
            kept = np.flatnonzero(take > 0)
            row, start, end = row[kept], start[kept], start[kept] + take[kept]
            laps = end // n[row]
            ids, replicate = b.column("__id").to_numpy()[row], b.column("__b").to_numpy()[row]
            for at, sign, whole in ((end - laps * n[row], 1.0, laps.astype(float)), (start, -1.0, np.zeros(len(row)))):
                columns = [ids, replicate, at, np.full(len(row), sign), whole]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["__id", "__b", "__i", "__sign", "__laps"])

    ends = draws.mapInArrow(block_ends, "__id long, __b int, __i long, __sign double, __laps double")
    hit = ends.join(F.broadcast(table) if (n_rows or 0) <= SMALL_TABLE else table, ["__id", "__i"], "left")
    part = lambda s: F.sum(C("__sign") * F.coalesce(C(s), F.lit(0.0)))
    stats = hit.groupBy("__id", "__b").agg(part("__s1").alias("__p1"), part("__s2").alias("__p2"), F.sum("__laps").alias("__laps"))
    stats = stats.join(size.select("__id", "__n", "__t1", "__t2"), "__id")
    mean = (C("__p1") + C("__laps") * C("__t1")) / C("__n")
    var = F.greatest((C("__p2") + C("__laps") * C("__t2")) / C("__n") - mean * mean, F.lit(0.0))
    sharpe = F.coalesce(ratio(mean, F.sqrt(var)) * math.sqrt(bars_per_year), F.lit(0.0))
    # One row per replicate from here on.
    sh = materialise(stats.select("__id", sharpe.alias("sharpe")))
    tail = (1 - level) / 2
    q = exact_quantiles(sh, ["__id"], "sharpe", {"ci_low": tail, "ci_high": 1 - tail})
    means = sh.groupBy("__id").agg(F.avg("sharpe").alias("mean_sharpe"))
    return size.select(*by, "__id").join(means, "__id").join(q, "__id").drop("__id", "n_values")
