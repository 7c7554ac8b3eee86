"""Second-generation features with a public definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitspark.functions.mathfn import ratio, rnd
from pitspark.operators import rolling as R
from pitspark.operators.chunked import over_rows, trailing
from pitspark.operators.intervals import per_bar
from pitspark.plans.registry import query, view
from pitspark.plans.series import SERIES
from pitspark.operators.versions import latest_by
from pitspark.sources.views import BAR, HOUR, Tables

C = F.col

view(
    "base2",
    "SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY bar_close)) AS r FROM bars",
    "bars",
)


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bar_close ROWS {n - 1} PRECEDING)"


_O = "(PARTITION BY symbol ORDER BY bar_close)"


def _vol(d, w):
    d = d.withColumn("r", R.log_return(C("close"), 1, w))
    return d.withColumn("rv8", R.std(C("r"), 8, 4, w))


def _variance_ratio(k: int):
    """Variance of k-step returns over k times that of single steps."""

    def compute(d, w):
        d = d.withColumn("r", R.log_return(C("close"), 1, w)).withColumn("rk", R.log_return(C("close"), k, w))
        n1, _, v1 = R.moments(C("r"), 240, w)
        nk, _, vk = R.moments(C("rk"), 240, w)
        d = d.withColumns({"n1": n1, "v1": v1, "nk": nk, "vk": vk})
        return d.withColumn("y", F.when((C("n1") >= 120) & (C("nk") >= 120), ratio(C("vk"), k * C("v1"))))

    return compute


def _variance_ratio_sql(k: int) -> str:
    return f"""WITH v AS (SELECT symbol, bar_close, r, ln(close) - ln(lag(close, {k}) OVER {_O}) AS rk FROM base2)
        SELECT symbol, bar_close, CASE WHEN count(r) OVER {_w(240)} >= 120 AND count(rk) OVER {_w(240)} >= 120
               THEN round(var_samp(rk) OVER {_w(240)} / nullif({k} * var_samp(r) OVER {_w(240)}, 0), 6) END AS value FROM v"""


def _efficiency(d, w):
    d = d.withColumn("step", F.abs(R.diff(C("close"), 1, w)))
    move = F.abs(R.diff(C("close"), 48, w))
    return d.withColumn("y", F.when(move.isNotNull(), ratio(move, R.total(C("step"), 48, 48, w))))


# name -> (SQL body over base2, lookback, compute adding y)
FEATURES = {
    "drawdown_30d_pct": (
        f"close / nullif(max(close) OVER {_w(720)}, 0) - 1",
        719,
        lambda d, w: d.withColumn("y", ratio(C("close"), F.max("close").over(trailing(w, 720))) - 1),
    ),
    "vol_of_vol_60d": (None, 70, lambda d, w: _vol(d, w).withColumn("y", R.std(C("rv8"), 60, 30, w))),
    "variance_ratio_8": (None, 248, _variance_ratio(8)),
    "variance_ratio_48": (None, 288, _variance_ratio(48)),
    "momentum_accel_4_1": (
        f"(ln(close) - ln(lag(close, 4) OVER {_O})) - (ln(close) - ln(lag(close, 1) OVER {_O}))",
        4,
        lambda d, w: d.withColumn("y", R.log_return(C("close"), 4, w) - R.log_return(C("close"), 1, w)),
    ),
    "trend_efficiency_48": (None, 49, _efficiency),
    "vwap_deviation": ("close / nullif(vwap, 0) - 1", 0, lambda d, w: d.withColumn("y", ratio(C("close"), C("vwap")) - 1)),
    "volume_zscore": (
        f"CASE WHEN count(volume) OVER {_w(20)} >= 10 THEN (volume - avg(volume) OVER {_w(20)}) / nullif(stddev_samp(volume) OVER {_w(20)}, 0) END",
        19,
        lambda d, w: d.withColumn("y", R.zscore(C("volume").cast("double"), 20, 10, w)),
    ),
    "bull_bear_regime": (
        f"CASE WHEN count(*) OVER {_w(200)} >= 200 THEN sign(avg(close) OVER {_w(20)} - avg(close) OVER {_w(200)})::DOUBLE END",
        199,
        lambda d, w: d.withColumns({"m200": R.moments(C("close"), 200, w)[1], "n200": R.moments(C("close"), 200, w)[0]}).withColumn(
            "y", F.when(C("n200") >= 200, F.signum(R.mean(C("close"), 20, 20, w) - C("m200")))
        ),
    ),
}
SQL = {
    "vol_of_vol_60d": f"""WITH v AS (SELECT symbol, bar_close, CASE WHEN count(r) OVER {_w(8)} >= 4 THEN stddev_samp(r) OVER {_w(8)} END AS rv8 FROM base2)
        SELECT symbol, bar_close, CASE WHEN count(rv8) OVER {_w(60)} >= 30 THEN round(stddev_samp(rv8) OVER {_w(60)}, 6) END AS value FROM v""",
    "variance_ratio_8": _variance_ratio_sql(8),
    "variance_ratio_48": _variance_ratio_sql(48),
    "trend_efficiency_48": f"""WITH v AS (SELECT symbol, bar_close, abs(close - lag(close) OVER {_O}) AS step, abs(close - lag(close, 48) OVER {_O}) AS mv FROM base2)
        SELECT symbol, bar_close, CASE WHEN mv IS NOT NULL AND count(step) OVER {_w(48)} >= 48 THEN round(mv / nullif(sum(step) OVER {_w(48)}, 0), 6) END AS value FROM v""",
}


def _register(name: str) -> None:
    expr, lookback, compute = FEATURES[name]
    sql = SQL.get(name) or f"SELECT symbol, bar_close, round({expr}, 6) + 0.0 AS value FROM base2"

    @query(f"v2_{name}", sql, "base2")
    def run(t: Tables):
        bars = t.bars.select("symbol", "bar_close", "close", "vwap", "volume")
        out = over_rows(bars, BAR, compute, lookback=lookback)
        return out.select("symbol", "bar_close", rnd(C("y")).alias("value"))


for _name in FEATURES:
    _register(_name)


@query(
    "v2_yield_inverted",
    """WITH j AS (SELECT a.series_id, a.date, (a.value < b.value)::INT::DOUBLE AS inv FROM latests a JOIN latests b ON a.date = b.date AND b.series_id = '5-LOW' WHERE a.series_id = '1-URGENT')
       SELECT date, inv AS inverted, CASE WHEN count(inv) OVER w >= 30 THEN round(avg(inv) OVER w, 6) END AS persistence_60d
       FROM j WINDOW w AS (ORDER BY date ROWS 59 PRECEDING)""",
    "latests",
)
def yield_inverted(t: Tables):
    """Inversion flag of two series and its 60-row persistence."""
    from pitspark.operators.intervals import legs_on_date

    latest = latest_by(t.vintages, ["series_id", "date"], order=["realtime_start"], pick=["value", "t_visible"])
    j = legs_on_date(
        latest,
        legs={"a": "1-URGENT", "b": "5-LOW"},
        series="series_id",
        formulas={"inverted": lambda v: (v["a"] < v["b"]).cast("double")},
    ).withColumn("series_id", F.lit("curve"))
    out = over_rows(
        j, SERIES, lambda d, w: d.withColumn("persistence_60d", rnd(R.mean(C("inverted"), 60, 30, w))), lookback=59
    )
    return out.select("date", "inverted", "persistence_60d")


@query(
    "v2_news_velocity_ratio",
    """WITH a AS (SELECT date_trunc('hour', t_visible) + INTERVAL 1 HOUR AS bar_close, count(*) AS n FROM articles GROUP BY 1),
       b AS (SELECT symbol, bar_close, coalesce(n, 0) AS n FROM bars LEFT JOIN a USING (bar_close))
       SELECT symbol, bar_close, round((sum(n) OVER w4 / 4.0) / nullif(sum(n) OVER w48 / 48.0, 0), 6) AS value
       FROM b WINDOW w4 AS (PARTITION BY symbol ORDER BY bar_close ROWS 3 PRECEDING), w48 AS (PARTITION BY symbol ORDER BY bar_close ROWS 47 PRECEDING)""",
    "articles bars",
)
def news_velocity(t: Tables):
    """News rate over 4 bars relative to 48 bars."""
    n = per_bar(t.article_times, time="t_visible", seconds=HOUR, aggs=[F.count(F.lit(1)).alias("n")])
    bars = t.bars.select("symbol", "bar_close").join(n, "bar_close", "left").fillna(0, ["n"])

    def compute(d, w):
        return d.withColumn("value", rnd(ratio(R.total(C("n"), 4, 1, w) / 4.0, R.total(C("n"), 48, 1, w) / 48.0)))

    return over_rows(bars, BAR, compute, lookback=47).select("symbol", "bar_close", "value")
