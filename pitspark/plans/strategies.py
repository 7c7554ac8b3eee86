"""Positions from features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitspark.functions import sessions as S
from pitspark.functions.mathfn import rnd, safe_ln
from pitspark.operators import labels as L
from pitspark.operators import rolling as R
from pitspark.operators import strategies as ST
from pitspark.operators.chunked import over_rows
from pitspark.operators.ranks import exact_quantiles
from pitspark.plans.labels import half_hour, session_momentum
from pitspark.plans.registry import query, view
from pitspark.plans.series import ewm_sql
from pitspark.session import materialise
from pitspark.sources.views import BAR, Tables

C = F.col


def bars(t: Tables, *more: str):
    return t.bars.select("symbol", "bar_close", "close", *more)


@query("pos_buy_hold", "SELECT symbol, bar_close, 1.0::DOUBLE AS position FROM bars", "bars")
def pos_buy_hold(t: Tables):
    """Always fully invested."""
    return ST.buy_hold()(bars(t), BAR).select("symbol", "bar_close", "position")


@query(
    "pos_ma_cross",
    f"""WITH f AS ({ewm_sql('lagged', 'close', '(2 / 51.0::DOUBLE)', 'y')}), s AS ({ewm_sql('lagged', 'close', '(2 / 201.0::DOUBLE)', 'y')}),
        r AS (SELECT f.symbol, f.bar_close, f.rn, CASE WHEN f.y > s.y THEN 1.0 ELSE -1.0 END AS raw FROM f JOIN s USING (symbol, bar_close))
        SELECT symbol, bar_close, (CASE WHEN rn <= 200 THEN 0.0 ELSE coalesce(lag(raw) OVER (PARTITION BY symbol ORDER BY bar_close), 0) END)::DOUBLE AS position FROM r""",
    "lagged",
)
def pos_ma_cross(t: Tables):
    """50/200 exponential average cross."""
    return ST.ma_cross()(bars(t), BAR).select("symbol", "bar_close", "position")


_DONCHIAN = """SELECT {k}, (coalesce(last_value(sig IGNORE NULLS) OVER ({p} ORDER BY bar_close ROWS UNBOUNDED PRECEDING), 0))::DOUBLE AS position FROM
    (SELECT {k}, CASE WHEN count(*) OVER w >= 20 AND close > max(close) OVER w THEN 1.0 WHEN count(*) OVER w >= 20 AND close < min(close) OVER w THEN -1.0 END AS sig
     FROM {src} WINDOW w AS ({p} ORDER BY bar_close ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


@query("pos_donchian", _DONCHIAN.format(k="symbol, bar_close", p="PARTITION BY symbol", src="bars"), "bars")
def pos_donchian(t: Tables):
    """20-bar channel breakout, held."""
    return ST.donchian(20)(bars(t), BAR).select("symbol", "bar_close", "position")


@query(
    "pos_session_rule",
    """WITH q AS (SELECT symbol, quantile_cont(rv, 2 / 3.0::DOUBLE) AS thr FROM half WHERE bar_close < TIMESTAMP '2024-01-20' AND rv IS NOT NULL GROUP BY 1),
       l AS (SELECT h.*, thr, coalesce(lead(day) OVER (PARTITION BY h.symbol ORDER BY bar_close) <> day, true) AS is_last FROM h5s h LEFT JOIN q USING (symbol)),
       s AS (SELECT *, CASE WHEN m IS NULL THEN 0 END AS z FROM (SELECT l.*, 1 AS m FROM l))
       SELECT symbol, bar_close, (CASE WHEN coalesce(rv > thr, false) THEN coalesce(sign(h5), 0) ELSE 0 END)::DOUBLE AS position FROM s""",
    "h5s",
)
def pos_session_rule(t: Tables):
    """Sign of the fifth half-hour return in high volatility."""
    half = half_hour(t)
    train = half.filter(C("bar_close") < F.lit("2024-01-20").cast("timestamp_ntz"))
    cut = exact_quantiles(train, ["symbol"], "rv", {"thr": 2 / 3}).select("symbol", "thr")
    rows = session_momentum(half).join(cut, "symbol", "left")
    rule = ST.session_rule(C("h5"), high_vol=C("rv") > C("thr"))
    return rule(rows, BAR).select("symbol", "bar_close", "position")


view(
    "sessions",
    """SELECT symbol, bar_close, close, coalesce(lead(sd) OVER w <> sd, true) AS is_last FROM
       (SELECT *, ((bar_open AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS sd FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY bar_close)""",
    "bars",
)
_FILL = """WITH dl AS (SELECT *, row_number() OVER w AS rn, abs(close - coalesce(lag(close) OVER w, close)) AS step, lag(close, 5) OVER w AS c5
                FROM sessions WHERE is_last WINDOW w AS (PARTITION BY symbol ORDER BY bar_close)),
       ef AS ({fast}), es AS ({slow}),
       sd AS (SELECT symbol, bar_close, rn, CASE WHEN rn = 14 THEN avg(step) OVER (PARTITION BY symbol ORDER BY bar_close ROWS 13 PRECEDING) ELSE step END AS x FROM dl),
       ea AS ({atr}),
       j AS (SELECT d.symbol, d.bar_close, sign(ef.y - es.y) AS trend, coalesce(sign(d.close / d.c5 - 1), 0) AS mom, count(*) OVER (PARTITION BY d.symbol) AS n,
             (CASE WHEN d.rn < 14 THEN avg(d.step) OVER (PARTITION BY d.symbol ORDER BY d.bar_close) ELSE ea.y END) / d.close AS rel
             FROM dl d JOIN ef USING (symbol, bar_close) JOIN es USING (symbol, bar_close) LEFT JOIN ea USING (symbol, bar_close)),
       p AS (SELECT symbol, bar_close, CASE WHEN n < 21 THEN 0 WHEN trend = mom THEN trend ELSE 0 END * CASE WHEN rel > 0 THEN least(0.01 / rel, 1.0) ELSE 0 END AS pos FROM j)
       SELECT s.symbol, s.bar_close, round(coalesce(p.pos, 0), 6)::DOUBLE + 0.0 AS position FROM sessions s
       ASOF LEFT JOIN p ON s.symbol = p.symbol AND s.bar_close > p.bar_close"""


@query(
    "pos_daily_fill",
    _FILL.format(
        fast=ewm_sql("dl", "close", "(2 / 6.0::DOUBLE)", "y"),
        slow=ewm_sql("dl", "close", "(2 / 21.0::DOUBLE)", "y"),
        atr=ewm_sql("sd", "x", "(1 / 14.0::DOUBLE)", "y", 14),
    ),
    "sessions",
)
def pos_daily_fill(t: Tables):
    """Session-close trend and momentum signal filled over the next session."""

    def compute(d, w):
        return d.withColumn("is_last", S.is_last_of_session(C("bar_open"), w))

    marked = over_rows(bars(t, "bar_open"), BAR, compute, lookback=0, lookahead=1)
    out = ST.daily_fill("is_last")(materialise(marked), BAR)
    return out.select("symbol", "bar_close", rnd(C("position")).alias("position"))


def model_rows(t: Tables):
    """Features, next return, label and a train flag per bar."""

    def compute(d, w):
        d = d.withColumn("r1", R.log_return(C("close"), 1, w))
        d = d.withColumn("f_ret4", R.log_return(C("close"), 4, w)).withColumn("f_vol8", R.std(C("r1"), 8, 8, w))
        d = d.withColumn("f_z20", R.zscore(C("close"), 20, 20, w)).withColumn("f_ret1", C("r1"))
        return d.withColumn("next_return", safe_ln(F.lead("close").over(w)) - safe_ln(C("close"))).drop("r1")

    rows = over_rows(bars(t), BAR, compute, lookback=21, lookahead=1)
    return rows.withColumn("label", L.fixed_label(C("next_return"))).withColumn(
        "is_train", C("bar_close") < F.lit("2024-01-20").cast("timestamp_ntz")
    )


FEATURES = ["f_ret1", "f_ret4", "f_vol8", "f_z20"]


@query("pos_tree")
def pos_tree(t: Tables):
    """Class of boosted trees minus one."""
    rows = materialise(model_rows(t))
    out = ST.tree_positions(rows, features=FEATURES, label="label", train=C("is_train"), trees=20, depth=3, rate=0.1)
    return out.select("symbol", "bar_close", "position")


@query("pos_linear")
def pos_linear(t: Tables):
    """Linear model on trend and seasonal lags, squashed."""
    rows = materialise(model_rows(t))
    out = ST.linear_positions(rows, BAR, train=C("is_train"), target="next_return")
    return out.select("symbol", "bar_close", rnd(C("position"), 4).alias("position"))
