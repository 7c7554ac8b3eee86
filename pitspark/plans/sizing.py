"""Sizing and exits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitspark.functions import sizing as Z
from pitspark.functions.mathfn import rnd
from pitspark.operators import exits as X
from pitspark.operators import rolling as R
from pitspark.operators.chunked import Running, over_rows, running
from pitspark.operators.sequential import drawdown_breaker
from pitspark.plans.registry import query, view
from pitspark.plans.series import ewm_args, with_atr
from pitspark.sources.views import BAR, DAILY, Tables

C = F.col

view(
    "sized",
    """SELECT symbol, bar_close, tanh(r) AS edge, rv * rv AS var, 0.0001::DOUBLE * volume AS post, coalesce(lag(tanh(r)) OVER (PARTITION BY symbol ORDER BY bar_close), 0) AS prev,
              (volume % 7) / 7.0::DOUBLE AS low FROM
       (SELECT *, CASE WHEN count(r) OVER w >= 60 THEN stddev_samp(r) OVER w END AS rv FROM
          (SELECT symbol, bar_close, volume, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY bar_close)) AS r FROM daily)
        WINDOW w AS (PARTITION BY symbol ORDER BY bar_close ROWS 59 PRECEDING))""",
    "daily",
)


def sized(t: Tables):
    """Edge, variances, lower bound and previous edge per bar."""

    def compute(d, w):
        d = d.withColumn("r", R.log_return(C("close"), 1, w))
        d = d.withColumn("rv", R.std(C("r"), 60, 60, w)).withColumn("edge", F.tanh("r"))
        return d.withColumn("prev", F.coalesce(F.lag("edge").over(w), F.lit(0.0)))

    d = over_rows(t.daily.select("symbol", "bar_close", "close", "volume"), DAILY, compute, lookback=61)
    return d.select(
        "symbol", "bar_close", "edge", (C("rv") * C("rv")).alias("var"), (C("volume") * 0.0001).alias("post"), "prev",
        (C("volume") % 7 / 7.0).alias("low"),
    )


_VT = "least(0.15::DOUBLE / greatest(sqrt(greatest(var, 0) * 3276), 1e-8), 3.0)"
_KELLY = """CASE WHEN edge IS NOT NULL AND {v} IS NOT NULL THEN greatest(least(CASE WHEN {v} > 0 THEN 0.4::DOUBLE * edge / {v} ELSE 0 END
   * CASE WHEN abs(edge) > 1e-6 THEN greatest(0, 1 - ({c}) / abs(edge)) ELSE 0 END, 1.0), -1.0) END"""
_COST = "(0.02::DOUBLE * sqrt(abs(edge - prev)) + 0.7::DOUBLE * abs(edge - prev) / 10000.0)"


@query("vol_target", f"SELECT symbol, bar_close, CASE WHEN var IS NOT NULL THEN round({_VT}, 6) END AS multiplier FROM sized", "sized")
def vol_target(t: Tables):
    """Multiplier to a target volatility."""
    return sized(t).select("symbol", "bar_close", rnd(Z.vol_target(C("var"))).alias("multiplier"))


@query("kelly_size", f"SELECT symbol, bar_close, round({_KELLY.format(v='var', c=_COST)}, 6) + 0.0 AS size FROM sized", "sized")
def kelly_size(t: Tables):
    """Friction-adjusted Kelly size."""
    from pitspark.functions.mathfn import sqrt_impact_cost

    cost = sqrt_impact_cost(F.abs(C("edge") - C("prev")))
    return sized(t).select("symbol", "bar_close", rnd(Z.kelly(C("edge"), C("var"), cost)).alias("size"))


@query("confidence_floor", "SELECT symbol, bar_close, round(CASE WHEN low >= 0.4 THEN edge ELSE 0 END, 6)::DOUBLE + 0.0 AS size FROM sized", "sized")
def confidence_floor(t: Tables):
    """No size below the confidence floor."""
    return sized(t).select("symbol", "bar_close", rnd(Z.confidence_floor(C("edge"), C("low"))).alias("size"))


@query(
    "sizer",
    f"""SELECT symbol, bar_close, CASE WHEN edge IS NOT NULL AND var IS NOT NULL THEN round(greatest(least(edge * {_VT}, 1.0), -1.0), 6) + 0.0 END AS stage1,
               CASE WHEN edge IS NOT NULL AND var IS NOT NULL THEN round(greatest(least(CASE WHEN low >= 0.4 THEN {_KELLY.format(v='(var + post)', c=_COST)} * {_VT} ELSE 0 END, 1.0), -1.0), 6) + 0.0 END AS stage2
        FROM sized""",
    "sized",
)
def sizer(t: Tables):
    """Both sizing stages."""
    s = sized(t)
    args = (C("edge"), C("low"), C("post"), C("var"), C("prev"))
    ok = C("edge").isNotNull() & C("var").isNotNull()
    return s.select(
        "symbol",
        "bar_close",
        F.when(ok, rnd(Z.size_position(*args, stage=1))).alias("stage1"),
        F.when(ok, rnd(Z.size_position(*args, stage=2))).alias("stage2"),
    )


view(
    "held",
    """WITH b AS (SELECT symbol, bar_close, close AS price, atr, rn, (rn - 1) // 48 AS block FROM (SELECT b.*, a.atr, a.rn FROM bars b JOIN atrs a USING (symbol, bar_close)) WHERE atr IS NOT NULL),
       e AS (SELECT symbol, block, arg_min(price, bar_close) AS entry_price, arg_min(atr, bar_close) AS entry_atr, min(bar_close) AS entry_time FROM b GROUP BY 1, 2)
       SELECT b.*, e.entry_price, e.entry_atr, CASE WHEN block % 2 = 0 THEN 1 ELSE -1 END AS side FROM b JOIN e USING (symbol, block) WHERE b.bar_close > e.entry_time""",
    "bars atrs",
)


def held(t: Tables):
    """Bars of one trade per 48-bar block: entered on its first bar."""
    d = over_rows(t.bars.select("symbol", "bar_close", "high", "low", "close"), BAR, with_atr, keep_pos="rn", **ewm_args(1 / 14, extra=1))
    d = d.filter(C("atr").isNotNull()).select(
        "symbol", "bar_close", C("close").alias("price"), "atr", F.floor((C("rn") - 1) / 48).cast("long").alias("block")
    )
    e = d.groupBy("symbol", "block").agg(
        F.min_by("price", "bar_close").alias("entry_price"), F.min_by("atr", "bar_close").alias("entry_atr"), F.min("bar_close").alias("entry_time")
    )
    side = F.when(C("block") % 2 == 0, 1).otherwise(-1)
    return d.join(e, ["symbol", "block"]).filter(C("bar_close") > C("entry_time")).withColumn("side", side)


@query(
    "atr_stop",
    """WITH w AS (SELECT *, CASE WHEN side > 0 THEN greatest(max(price) OVER o, entry_price) ELSE least(min(price) OVER o, entry_price) END AS best FROM held
                 WINDOW o AS (PARTITION BY symbol, block ORDER BY bar_close)),
       s AS (SELECT *, CASE WHEN side > 0 THEN CASE WHEN best > entry_price THEN greatest(entry_price - 2 * entry_atr, best - 1.5 * atr) ELSE entry_price - 2 * entry_atr END
             ELSE CASE WHEN best < entry_price THEN least(entry_price + 2 * entry_atr, best + 1.5 * atr) ELSE entry_price + 2 * entry_atr END END AS stop FROM w),
       x AS (SELECT *, CASE WHEN side > 0 THEN price < stop ELSE price > stop END AS ex FROM s)
       SELECT symbol, block, min(bar_close) FILTER (WHERE ex) AS exit_time, arg_min(price, bar_close) FILTER (WHERE ex) AS exit_price FROM x GROUP BY 1, 2""",
    "held",
)
def atr_stop(t: Tables):
    """First bar of each trade that crosses its hard or trailing stop."""
    s = X.atr_stop(held(t), trade=["symbol", "block"], time="bar_close")
    return X.first_exit(s, trade=["symbol", "block"], time="bar_close", price="price")


@query(
    "timeout_exit",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol, block ORDER BY bar_close) AS held_bars FROM held)
       SELECT symbol, block, min(bar_close) FILTER (WHERE held_bars >= 20) AS exit_time, arg_min(price, bar_close) FILTER (WHERE held_bars >= 20) AS exit_price FROM n GROUP BY 1, 2""",
    "held",
)
def timeout_exit(t: Tables):
    """Bar at which each trade reaches the holding limit."""
    s = X.timeout(held(t), trade=["symbol", "block"], time="bar_close", max_bars=20)
    return X.first_exit(s, trade=["symbol", "block"], time="bar_close", price="price")


@query(
    "drawdown_breaker",
    """WITH RECURSIVE e AS (SELECT symbol, bar_close, row_number() OVER w AS rn, exp(sum(coalesce(r, 0) / 20) OVER w) AS equity FROM
         (SELECT symbol, bar_close, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY bar_close)) AS r FROM daily) WINDOW w AS (PARTITION BY symbol ORDER BY bar_close)),
       d AS (SELECT *, (equity - pk) / pk AS dd FROM (SELECT *, greatest(1.0, max(equity) OVER (PARTITION BY symbol ORDER BY bar_close)) AS pk FROM e)),
       l AS (SELECT symbol, bar_close, rn, CASE WHEN dd <= -0.15 + 1e-9 THEN 3 WHEN dd <= -0.10 + 1e-9 THEN 2 WHEN dd <= -0.05 + 1e-9 THEN 1 ELSE 0 END AS lv FROM d),
       s AS (SELECT symbol, 0::BIGINT AS rn, 0 AS st, 0 AS h FROM (SELECT DISTINCT symbol FROM l)
         UNION ALL SELECT l.symbol, l.rn, CASE WHEN s.st = 3 AND s.h >= 65 THEN 0 ELSE l.lv END,
           CASE WHEN s.st = 3 AND s.h >= 65 THEN 0 WHEN l.lv = 3 THEN s.h + 1 WHEN l.lv = 0 THEN 0 ELSE s.h END
         FROM s JOIN l ON l.symbol = s.symbol AND l.rn = s.rn + 1)
       SELECT l.symbol, l.bar_close, l.lv::BIGINT AS level, (CASE st WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.0 END)::DOUBLE AS size_multiplier
       FROM s JOIN l USING (symbol, rn)""",
    "daily",
)
def breaker(t: Tables):
    """Size multiplier of the four-state drawdown breaker."""

    def compute(d, w):
        return d.withColumn("r", F.coalesce(R.log_return(C("close"), 1, w), F.lit(0.0)) / 20)

    r = over_rows(t.daily.select("symbol", "bar_close", "close"), DAILY, compute, lookback=1)
    e = running(r, DAILY, [Running("cum", "sum", C("r"))]).select("symbol", "bar_close", F.exp("cum").alias("equity"))
    out = drawdown_breaker(e, DAILY, equity="equity")
    return out.select("symbol", "bar_close", C("level").cast("long").alias("level"), "size_multiplier")
