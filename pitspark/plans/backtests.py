"""Backtests and performance reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pitspark.functions.mathfn import EULER_GAMMA, normal_quantile, rnd, safe_ln, sqrt_impact_cost
from pitspark.operators import backtest as B
from pitspark.operators import rolling as R
from pitspark.operators import strategies as ST
from pitspark.operators.asof import event_within, nearest_events
from pitspark.operators.chunked import SeriesKey, over_rows
from pitspark.operators.ranks import exact_quantiles
from pitspark.plans.labels import folded
from pitspark.plans.registry import query, view
from pitspark.plans.series import ewm_sql
from pitspark.plans.strategies import _DONCHIAN
from pitspark.session import materialise
from pitspark.sources.views import DAILY, DAY, Tables

C = F.col
FOLD_KEY = SeriesKey(("symbol", "fold"), "bar_close", (), 365 * DAY)
RUN_KEY = SeriesKey(("strategy", "symbol", "fold"), "bar_close", (), 365 * DAY)
STRATEGIES = {"buy_hold": ST.buy_hold(), "ma_cross": ST.ma_cross(5, 20), "donchian": ST.donchian(20)}
N = len(STRATEGIES)

view(
    "testbars",
    """SELECT symbol, fold, bar_close, close, news, nr, row_number() OVER (PARTITION BY symbol, fold ORDER BY bar_close) AS rn FROM
       (SELECT f.*, n.nr FROM folded f JOIN (SELECT symbol, bar_close, ln(lead(close) OVER (PARTITION BY symbol ORDER BY bar_close)) - ln(close) AS nr FROM daily) n
        USING (symbol, bar_close)) WHERE role = 'test'""",
    "folded daily",
)


def _fold_ewm(alpha: str) -> str:
    return ewm_sql("testbars", "close", alpha, "y").replace("a.symbol, a.bar_close, a.rn", "a.symbol, a.fold, a.bar_close, a.rn").replace(
        "a.symbol = b.symbol AND", "a.symbol = b.symbol AND a.fold = b.fold AND"
    ).replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2, 3, 4")


view("testfast", _fold_ewm("(2 / 6.0::DOUBLE)"), "testbars")
view("testslow", _fold_ewm("(2 / 21.0::DOUBLE)"), "testbars")
view(
    "testpos",
    f"""SELECT 'buy_hold' AS strategy, symbol, fold, bar_close, 1.0::DOUBLE AS position FROM testbars
        UNION ALL SELECT 'ma_cross', symbol, fold, bar_close, CASE WHEN rn <= 20 THEN 0 ELSE coalesce(lag(raw) OVER (PARTITION BY symbol, fold ORDER BY bar_close), 0) END::DOUBLE
          FROM (SELECT f.*, CASE WHEN f.y > s.y THEN 1.0 ELSE -1.0 END AS raw FROM testfast f JOIN testslow s USING (symbol, fold, bar_close))
        UNION ALL SELECT 'donchian', * FROM ({_DONCHIAN.format(k='symbol, fold, bar_close', p='PARTITION BY symbol, fold', src='testbars')})""",
    "testbars testfast testslow",
)
view(
    "testpnl",
    """SELECT p.strategy, p.symbol, p.fold, p.bar_close, p.position, b.news, b.nr,
              abs(p.position - coalesce(lag(p.position) OVER (PARTITION BY p.strategy, p.symbol, p.fold ORDER BY p.bar_close), 0)) AS delta
       FROM testpos p JOIN testbars b USING (symbol, fold, bar_close)""",
    "testpos testbars",
)
view(
    "testlong",
    """SELECT *, position * coalesce(nr, 0) - multiplier * 2.0 * delta / 10000.0 AS pnl FROM (
         SELECT t.*, m AS multiplier, 'both' AS bucket FROM testpnl t, (VALUES (0.5::DOUBLE), (1.0), (1.5)) v(m)
         UNION ALL SELECT t.*, 1.0, CASE WHEN news THEN 'present' ELSE 'absent' END FROM testpnl t)""",
    "testpnl",
)
view(
    "testcurve",
    """SELECT *, exp(max(cum) OVER (PARTITION BY strategy, symbol, fold, multiplier, bucket ORDER BY bar_close)) AS peak, exp(cum) AS equity FROM
       (SELECT *, sum(pnl) OVER (PARTITION BY strategy, symbol, fold, multiplier, bucket ORDER BY bar_close) AS cum FROM testlong)""",
    "testlong",
)
_BUNDLE = """round(coalesce(avg({r}) / nullif(stddev_samp({r}), 0) * sqrt(3276), 0), {p}) + 0.0 AS sharpe,
   round(coalesce(avg({r}) / nullif(sqrt(avg(least({r}, 0) ** 2)), 0) * sqrt(3276), 0), {p}) + 0.0 AS sortino,
   round(coalesce(avg({r}) * 3276 / nullif(max((peak - equity) / greatest(peak, 1e-12)), 0), 0), {p}) + 0.0 AS calmar,
   round(max((peak - equity) / greatest(peak, 1e-12)), 6) AS max_drawdown,
   round(coalesce(count(*) FILTER (WHERE {r} > 0) / nullif(count(*) FILTER (WHERE {r} <> 0), 0), 0), 6) AS hit_rate,
   round(CASE WHEN coalesce(sum({r}) FILTER (WHERE {r} < 0), 0) = 0 AND coalesce(sum({r}) FILTER (WHERE {r} > 0), 0) > 0 THEN NULL
      ELSE coalesce(coalesce(sum({r}) FILTER (WHERE {r} > 0), 0) / nullif(-sum({r}) FILTER (WHERE {r} < 0), 0), 0) END, 6) AS profit_factor,
   round(coalesce(avg({r}) FILTER (WHERE {r} <> 0), 0), 6) + 0.0 AS expectancy, count(*) AS n_bars""".format(r="pnl", p=5)
BUNDLE = ("sharpe", "sortino", "calmar", "max_drawdown", "hit_rate", "profit_factor", "expectancy")


def rounded(df, *keys: str):
    places = {"sharpe": 5, "sortino": 5, "calmar": 5}
    return df.select(*keys, *[rnd(C(m), places.get(m, 6)).alias(m) for m in BUNDLE], "n_bars")


def test_rows(t: Tables):
    """Test bars of every fold with the next return and a news flag."""

    def compute(d, w):
        return d.withColumn("next_return", safe_ln(F.lead("close").over(w)) - safe_ln(C("close")))

    bars = over_rows(t.daily.select("symbol", "bar_close", "close", "news"), DAILY, compute, lookback=0, lookahead=1)
    return folded(t, bars).filter(C("role") == "test").drop("role")


def strategy_rows(t: Tables):
    base = materialise(test_rows(t))
    keep = ["symbol", "fold", "bar_close", "next_return", "news"]
    return materialise(ST.run_strategies(base, FOLD_KEY, STRATEGIES, keep))


@query(
    "backtest_pnl",
    """SELECT strategy, symbol, fold, bar_close, round(delta, 6) AS delta, round(pnl, 6) + 0.0 AS pnl, round(ln(equity), 6) + 0.0 AS log_equity, round(1 - equity / peak, 6) + 0.0 AS drawdown
       FROM testcurve WHERE multiplier = 1.0 AND bucket = 'both'""",
    "testcurve",
)
def backtest_pnl(t: Tables):
    """Per-bar result, equity and its peak."""
    out = B.backtest(strategy_rows(t), RUN_KEY)
    out = out.withColumn("log_equity", F.ln("equity")).withColumn("drawdown", 1 - C("equity") / C("peak"))
    cols = ("delta", "pnl", "log_equity", "drawdown")
    return out.select("strategy", "symbol", "fold", "bar_close", *[rnd(C(c)).alias(c) for c in cols])


@query(
    "cost_sqrt",
    """SELECT strategy, symbol, fold, bar_close, round(0.02 * sqrt(delta) + 0.7 * delta / 10000.0, 8) AS cost FROM testpnl""",
    "testpnl",
)
def cost_sqrt(t: Tables):
    """Square-root impact cost of every trade."""
    tr = B.trades(strategy_rows(t), RUN_KEY)
    return tr.select("strategy", "symbol", "fold", "bar_close", rnd(sqrt_impact_cost(C("delta")), 8).alias("cost"))


@query(
    "metrics_bundle",
    f"SELECT strategy, symbol, fold, {_BUNDLE} FROM testcurve WHERE multiplier = 1.0 AND bucket = 'both' GROUP BY 1, 2, 3",
    "testcurve",
)
def metrics_bundle(t: Tables):
    """All performance metrics per strategy, series and fold."""
    out = B.metrics(B.backtest(strategy_rows(t), RUN_KEY), RUN_KEY.by)
    return rounded(out, *RUN_KEY.by)


@query(
    "per_bucket_metrics",
    f"""WITH g AS (SELECT DISTINCT strategy, symbol, fold, b AS bucket FROM testpnl, (VALUES ('present'), ('absent'), ('both')) v(b)),
        m AS (SELECT strategy, symbol, fold, bucket, {_BUNDLE} FROM testcurve WHERE multiplier = 1.0 GROUP BY 1, 2, 3, 4)
        SELECT strategy, symbol, fold, bucket, coalesce(sharpe, 0) AS sharpe, coalesce(sortino, 0) AS sortino, coalesce(calmar, 0) AS calmar, coalesce(max_drawdown, 0) AS max_drawdown,
               coalesce(hit_rate, 0) AS hit_rate, CASE WHEN n_bars IS NULL THEN 0 ELSE profit_factor END AS profit_factor, coalesce(expectancy, 0) AS expectancy, coalesce(n_bars, 0) AS n_bars
        FROM g LEFT JOIN m USING (strategy, symbol, fold, bucket)""",
    "testcurve testpnl",
)
def per_bucket_metrics(t: Tables):
    """Metrics on bars with news, without news and on both."""
    tr = B.trades(strategy_rows(t), RUN_KEY)
    tr = materialise(tr.withColumn("pnl", B.pnl(C("next_return"), C("position"), C("delta"), B.linear_cost(2.0))))
    out = B.bucket_metrics(tr, RUN_KEY, present=C("news"))
    return rounded(out, *RUN_KEY.by, "bucket")


_BEST = (1 - EULER_GAMMA) * normal_quantile(1 - 1 / N) + EULER_GAMMA * normal_quantile(1 - 1 / (N * math.e))
_PHI = """(CASE WHEN z >= 0 THEN 1 - u ELSE u END)"""


@query(
    "deflated_sharpe",
    f"""WITH m AS (SELECT strategy, symbol, fold, coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(3276), 0) AS s, count(*) AS n
                   FROM testcurve WHERE multiplier = 1.0 AND bucket = 'both' GROUP BY 1, 2, 3),
        z AS (SELECT *, (s - {_BEST!r}) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 + 0.5 * s * s)) AS z FROM m),
        k AS (SELECT unnest(generate_series(0, 4000)) AS i),
        u AS (SELECT z.*, i.u FROM z, LATERAL (SELECT sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(least(abs(z), 40) + i * 0.0025, 2) / 2)) * 0.0025 / 3 / sqrt(2 * pi()) AS u FROM k) i)
        SELECT strategy, symbol, fold, round({_PHI}, 6) + 0.0 AS dsr_p, round(s - {_BEST!r}, 6) AS dsr FROM u""",
    "testcurve",
)
def deflated_sharpe(t: Tables):
    """Sharpe ratio corrected for the number of strategies tried."""
    m = B.metrics(B.backtest(strategy_rows(t), RUN_KEY), RUN_KEY.by)
    p, v = B.deflated_sharpe(C("sharpe"), C("n_bars"), N)
    return m.select(*RUN_KEY.by, rnd(p).alias("dsr_p"), rnd(v).alias("dsr"))


@query(
    "cost_stress",
    f"SELECT strategy, symbol, fold, multiplier, {_BUNDLE} FROM testcurve WHERE bucket = 'both' GROUP BY 1, 2, 3, 4",
    "testcurve",
)
def cost_stress(t: Tables):
    """Metrics at half, full and one-and-a-half cost."""
    return rounded(B.cost_stress(strategy_rows(t), RUN_KEY), *RUN_KEY.by, "multiplier")


@query(
    "cost_monotone",
    """WITH m AS (SELECT strategy, symbol, fold, multiplier, coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(3276), 0) AS s FROM testcurve WHERE bucket = 'both' GROUP BY 1, 2, 3, 4),
       l AS (SELECT *, lag(s) OVER (PARTITION BY strategy, symbol, fold ORDER BY multiplier) AS p FROM m)
       SELECT strategy, symbol, fold, bool_and(coalesce(s <= p + 1e-6, true)) AS monotone, bool_or(multiplier = 1.5 AND s > 0.5) AS passes_gate FROM l GROUP BY 1, 2, 3""",
    "testcurve",
)
def cost_monotone(t: Tables):
    """Sharpe falls with cost, and clears the gate at 1.5x."""
    return B.monotone(B.cost_stress(strategy_rows(t), RUN_KEY), RUN_KEY.by)


view(
    "wfe",
    f"SELECT strategy, symbol, fold, multiplier, bucket, {_BUNDLE} FROM testcurve GROUP BY 1, 2, 3, 4, 5",
    "testcurve",
)


def evaluation(t: Tables):
    return B.walk_forward(strategy_rows(t), RUN_KEY, present=C("news"), n_trials=N)


@query("walk_forward_eval", f"SELECT *, CASE WHEN multiplier = 1.0 AND bucket = 'both' THEN round(sharpe - {_BEST!r}, 4) END AS dsr FROM wfe", "wfe")
def walk_forward_eval(t: Tables):
    """Every strategy, fold, cost level and bucket in one table."""
    out = evaluation(t)
    keys = [*RUN_KEY.by, "multiplier", "bucket"]
    return rounded(out, *keys, "dsr").withColumn("dsr", rnd(C("dsr"), 4))


@query(
    "promotion_gates",
    f"""WITH f AS (SELECT symbol, fold, max(sharpe) FILTER (WHERE strategy = 'donchian' AND bucket = 'both' AND multiplier = 1.0) AS m1,
             max(sharpe) FILTER (WHERE strategy = 'donchian' AND bucket = 'both' AND multiplier = 1.5) AS m15,
             max(sharpe) FILTER (WHERE strategy <> 'donchian' AND bucket = 'both' AND multiplier = 1.0) AS best,
             max(sharpe) FILTER (WHERE strategy = 'donchian' AND bucket = 'present') AS pr, max(sharpe) FILTER (WHERE strategy = 'donchian' AND bucket = 'absent') AS ab FROM wfe GROUP BY 1, 2),
        a AS (SELECT avg(m1) AS g1, avg(m15) AS g2, count(*) FILTER (WHERE m1 - best >= 0.2) AS g3, min(m1) - {_BEST!r} AS g7,
              count(*) FILTER (WHERE coalesce(pr > 0 AND ab > 0, false)) AS g8, count(*) AS n FROM f)
        SELECT '1_sharpe_1x' AS gate, round(g1, 3)::DOUBLE AS value, 1.0::DOUBLE AS threshold, g1 > 1.0 AS passed FROM a
        UNION ALL SELECT '2_sharpe_1_5x', round(g2, 3), 0.5, g2 > 0.5 FROM a UNION ALL SELECT '3_beats_baseline', g3, 3, g3 >= 3 FROM a
        UNION ALL SELECT '4_coverage', NULL, NULL, NULL UNION ALL SELECT '5_sizer_stage', NULL, NULL, NULL UNION ALL SELECT '6_breaker_regimes', NULL, NULL, NULL
        UNION ALL SELECT '7_dsr', round(g7, 3), 1.0, g7 > 1.0 FROM a UNION ALL SELECT '8_bucket_positive', g8, n, g8 = n FROM a""",
    "wfe",
)
def promotion_gates(t: Tables):
    """Pass/fail table of the promotion gates for one strategy as the model."""
    g = B.promotion_gates(evaluation(t), model="donchian", fold=["symbol", "fold"])
    return g.withColumn("value", rnd(C("value"), 3))


@query(
    "report_pivot",
    """SELECT strategy, round(avg(sharpe) FILTER (WHERE multiplier = 0.5), 3) AS m_0_5, round(avg(sharpe) FILTER (WHERE multiplier = 1.0 AND bucket = 'both'), 3) AS m_1_0,
              round(avg(sharpe) FILTER (WHERE multiplier = 1.5), 3) AS m_1_5, round(avg(sharpe) FILTER (WHERE bucket = 'present'), 3) AS present,
              round(avg(sharpe) FILTER (WHERE bucket = 'absent'), 3) AS absent FROM wfe GROUP BY 1""",
    "wfe",
)
def report_pivot(t: Tables):
    """Mean Sharpe by cost level and by bucket, one row per strategy."""
    both = C("bucket") == "both"
    cols = {
        "m_0_5": both & (C("multiplier") == 0.5),
        "m_1_0": both & (C("multiplier") == 1.0),
        "m_1_5": both & (C("multiplier") == 1.5),
        "present": C("bucket") == "present",
        "absent": C("bucket") == "absent",
    }
    out = evaluation(t)
    return out.groupBy("strategy").agg(*[rnd(F.avg(F.when(c, C("sharpe"))), 3).alias(n) for n, c in cols.items()])


@query(
    "report_by_fold",
    """SELECT strategy, fold, round(avg(sharpe) FILTER (WHERE multiplier = 1.0 AND bucket = 'both'), 3) AS sharpe,
              round(avg(max_drawdown) FILTER (WHERE multiplier = 1.0 AND bucket = 'both'), 3) + 0.0 AS max_drawdown FROM wfe GROUP BY 1, 2""",
    "wfe",
)
def report_by_fold(t: Tables):
    """Sharpe and drawdown of each strategy in each fold, over all series."""
    plain = (C("bucket") == "both") & (C("multiplier") == 1.0)
    mean = lambda c: rnd(F.avg(F.when(plain, C(c))), 3).alias(c)
    return evaluation(t).groupBy("strategy", "fold").agg(mean("sharpe"), mean("max_drawdown"))


@query(
    "trade_stats",
    """SELECT strategy, symbol, fold, round(sum(delta) * 3276 / count(*), 6) AS turnover, count(*) FILTER (WHERE delta <> 0) AS trade_count,
              round(exp(sum(pnl)) - 1, 3) + 0.0 AS total_return FROM testcurve WHERE multiplier = 1.0 AND bucket = 'both' GROUP BY 1, 2, 3""",
    "testcurve",
)
def trade_stats(t: Tables):
    """Turnover, trades and compounded return."""
    out = B.backtest(strategy_rows(t), RUN_KEY)
    s = B.trade_stats(out, RUN_KEY.by)
    return s.select(*RUN_KEY.by, rnd(C("turnover")).alias("turnover"), "trade_count", rnd(C("total_return"), 3).alias("total_return"))


@query("sharpe_bootstrap")
def sharpe_bootstrap(t: Tables):
    """Block-bootstrap interval of the Sharpe ratio."""
    rows = materialise(B.backtest(strategy_rows(t), RUN_KEY).select(*RUN_KEY.by, "bar_close", "pnl"))
    out = B.bootstrap_sharpe(rows, RUN_KEY)
    return out.select(*RUN_KEY.by, *[rnd(C(c)).alias(c) for c in ("mean_sharpe", "ci_low", "ci_high")])


@query(
    "regime_metrics",
    f"""WITH r AS (SELECT symbol, bar_close, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY bar_close)) AS r, volume,
              ln(lead(close) OVER (PARTITION BY symbol ORDER BY bar_close)) - ln(close) AS nr FROM daily),
        v AS (SELECT *, CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w END AS rv FROM r WINDOW w AS (PARTITION BY symbol ORDER BY bar_close ROWS 19 PRECEDING)),
        q AS (SELECT symbol, quantile_cont(rv, 0.33::DOUBLE) AS lo, quantile_cont(rv, 0.66::DOUBLE) AS hi, quantile_cont(volume::DOUBLE, 0.75::DOUBLE) AS nd FROM v GROUP BY 1),
        e AS (SELECT v.*, lo, hi, nd, EXISTS (SELECT 1 FROM schedule s WHERE event_type = 'NFP' AND event_ts BETWEEN bar_close - INTERVAL 3 DAY AND bar_close + INTERVAL 3 DAY) AS wk
              FROM v JOIN q USING (symbol)),
        x AS (SELECT symbol, CASE WHEN coalesce(rv > hi, false) THEN 'high_vol' WHEN coalesce(rv < lo, false) THEN 'low_vol' ELSE 'mid_vol' END AS regime, coalesce(nr, 0) AS pnl FROM e
              UNION ALL SELECT symbol, CASE WHEN wk THEN 'event_week' ELSE 'no_event' END, coalesce(nr, 0) FROM e
              UNION ALL SELECT symbol, CASE WHEN volume > nd THEN 'high_news' ELSE 'low_news' END, coalesce(nr, 0) FROM e)
        SELECT symbol, regime, round(coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(3276), 0), 5) + 0.0 AS sharpe,
               round(coalesce(count(*) FILTER (WHERE pnl > 0) / nullif(count(*) FILTER (WHERE pnl <> 0), 0), 0), 6) AS hit_rate, count(*) AS n_bars FROM x GROUP BY 1, 2""",
    "daily schedule",
)
def regime_metrics(t: Tables):
    """Metrics per volatility third, event week and news density."""

    def compute(d, w):
        d = d.withColumn("r", R.log_return(C("close"), 1, w))
        d = d.withColumn("rv", R.std(C("r"), 20, 20, w))
        return d.withColumn("pnl", F.coalesce(safe_ln(F.lead("close").over(w)) - safe_ln(C("close")), F.lit(0.0)))

    rows = over_rows(t.daily.select("symbol", "bar_close", "close", "volume"), DAILY, compute, lookback=20, lookahead=1)
    nfp = t.schedule.filter(C("event_type") == "NFP").select("event_ts")
    rows = materialise(nearest_events(rows, nfp, left_time="bar_close", event_time="event_ts", bucket_seconds=90 * DAY))
    vol = exact_quantiles(rows, ["symbol"], "rv", {"lo": 0.33, "hi": 0.66}).drop("n_values")
    news = exact_quantiles(rows, ["symbol"], "volume", {"nd": 0.75}).drop("n_values")
    e = rows.join(vol, "symbol").join(news, "symbol")
    week = event_within(C("prev_event"), C("next_event"), C("bar_close"), 3 * DAY)
    regimes = F.array(
        F.when(C("rv") > C("hi"), "high_vol").when(C("rv") < C("lo"), "low_vol").otherwise("mid_vol"),
        F.when(week, "event_week").otherwise("no_event"),
        F.when(C("volume") > C("nd"), "high_news").otherwise("low_news"),
    )
    long = e.select("symbol", "pnl", F.explode(regimes).alias("regime"))
    out = B.metrics(long, ["symbol", "regime"])
    return out.select("symbol", "regime", rnd(C("sharpe"), 5).alias("sharpe"), rnd(C("hit_rate")).alias("hit_rate"), "n_bars")
