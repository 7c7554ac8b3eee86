"""Window and time-series features per series."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.functions.mathfn import clip, ratio, rnd
from pitspark.operators import rolling as R
from pitspark.operators.asof import asof_join
from pitspark.operators.chunked import (
    POS,
    Ewm,
    Running,
    SeriesKey,
    ewm_block,
    over_rows,
    over_time,
    running,
    with_ewm,
    trailing,
)
from pitspark.operators.versions import latest_by
from pitspark.plans.registry import query, view
from pitspark.sources.views import BAR, DAY, Tables

C = F.col
KEY = ("symbol", "bar_close")

# Helper views of the checks.
view(
    "lagged",
    """SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS c1, lag(open) OVER w AS o1, lag(high) OVER w AS h1,
              lag(low) OVER w AS l1, lag(volume) OVER w AS v1
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_close)""",
    "bars",
)
view(
    "returns",
    "SELECT *, ln(c1) - ln(lag(c1) OVER (PARTITION BY symbol ORDER BY bar_close)) AS r1 FROM lagged",
    "lagged",
)
view(
    "firsts",
    """SELECT series_id, date, min(realtime_start) AS t_visible, arg_min(value, realtime_start) AS value
       FROM vintages GROUP BY 1, 2""",
    "vintages",
)
view(
    "latests",
    """SELECT series_id, date, max(realtime_start) AS t_visible, arg_max(value, realtime_start) AS value
       FROM vintages GROUP BY 1, 2""",
    "vintages",
)

SERIES = SeriesKey(("series_id",), "date", (), 365 * DAY)
BOOK = SeriesKey(("contract",), "report_date", (), 20 * 365 * DAY)


def bars_of(t: Tables, *cols: str) -> DataFrame:
    return t.bars.select("symbol", "bar_close", *cols)


def with_cols(d: DataFrame, **cols) -> DataFrame:
    return d.withColumns(cols)


def finish(d: DataFrame, *cols: str, keys=KEY, places: int = 6) -> DataFrame:
    return d.select(*keys, *[rnd(C(c), places).alias(c) for c in cols])


@query(
    "lagged_bars",
    """SELECT symbol, bar_close, lag(open) OVER w AS lag1_open, lag(high) OVER w AS lag1_high, lag(low) OVER w AS lag1_low,
              lag(close) OVER w AS lag1_close, lag(volume) OVER w AS lag1_volume, round(lag(vwap) OVER w, 8) AS lag1_vwap,
              lead(close) OVER w AS next_close
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_close)""",
    "bars",
)
def lagged_bars(t: Tables):
    """Previous bar's fields and the next close."""
    fields = ("open", "high", "low", "close", "volume", "vwap")

    def compute(d, w):
        d = with_cols(d, next_close=F.lead("close").over(w), **{f"lag1_{f}": F.lag(f).over(w) for f in fields})
        return d.withColumn("lag1_vwap", rnd(C("lag1_vwap"), 8))

    out = over_rows(bars_of(t, *fields), BAR, compute, lookback=1, lookahead=1)
    return out.select(*KEY, *[f"lag1_{f}" for f in fields], "next_close")


@query(
    "change_1d",
    """SELECT series_id, date, value AS level, round(value - lag(value) OVER (PARTITION BY series_id ORDER BY date), 8) AS change_1d
       FROM latests""",
    "latests",
)
def change_1d(t: Tables):
    """Level and one-step change of the latest revision."""
    levels = latest_by(t.vintages, ["series_id", "date"], order=["realtime_start"], pick=["value"])
    out = over_rows(levels, SERIES, lambda d, w: d.withColumn("change_1d", rnd(R.diff(C("value"), 1, w), 8)), lookback=1)
    return out.select("series_id", "date", C("value").alias("level"), "change_1d")


@query(
    "log_returns",
    """SELECT symbol, bar_close, round(ln(c1) - ln(lag(c1, 1) OVER w), 6) AS log_return_1, round(ln(c1) - ln(lag(c1, 4) OVER w), 6) AS log_return_4,
              round(ln(c1) - ln(lag(c1, 16) OVER w), 6) AS log_return_16, round(ln(c1) - ln(lag(c1, 48) OVER w), 6) AS log_return_48
       FROM lagged WINDOW w AS (PARTITION BY symbol ORDER BY bar_close)""",
    "lagged",
)
def log_returns(t: Tables):
    """Log returns over 1/4/16/48 bars of the lagged close."""
    steps = (1, 4, 16, 48)

    def compute(d, w):
        d = d.withColumn("c1", F.lag("close").over(w))
        return with_cols(d, **{f"log_return_{k}": R.log_return(C("c1"), k, w) for k in steps})

    return finish(over_rows(bars_of(t, "close"), BAR, compute, lookback=49), *[f"log_return_{k}" for k in steps])


@query(
    "rolling_mean",
    """SELECT series_id, date, CASE WHEN count(value) OVER w4 >= 2 THEN round(avg(value) OVER w4, 6) END AS ma_4,
              CASE WHEN count(value) OVER w20 >= 10 THEN round(sum(value) OVER w20, 5) END AS sum_20
       FROM firsts WINDOW w4 AS (PARTITION BY series_id ORDER BY date ROWS 3 PRECEDING),
                          w20 AS (PARTITION BY series_id ORDER BY date ROWS 19 PRECEDING)""",
    "firsts",
)
def rolling_mean(t: Tables):
    """Trailing mean and sum with minimum periods over first releases."""
    first = latest_by(t.vintages, ["series_id", "date"], order=["realtime_start"], pick=["value"], first=True)

    def compute(d, w):
        return with_cols(
            d, ma_4=rnd(R.mean(C("value"), 4, 2, w), 6), sum_20=rnd(R.total(C("value"), 20, 10, w), 5)
        )

    return over_rows(first, SERIES, compute, lookback=19).select("series_id", "date", "ma_4", "sum_20")


@query(
    "realized_vol",
    """SELECT symbol, bar_close, CASE WHEN count(r1) OVER w8 >= 4 THEN round(stddev_samp(r1) OVER w8, 6) END AS realized_vol_8,
              CASE WHEN count(r1) OVER w48 >= 24 THEN round(stddev_samp(r1) OVER w48, 6) END AS realized_vol_48,
              CASE WHEN count(r1) OVER w240 >= 120 THEN round(stddev_samp(r1) OVER w240, 6) END AS realized_vol_240
       FROM returns WINDOW w8 AS (PARTITION BY symbol ORDER BY bar_close ROWS 7 PRECEDING),
            w48 AS (PARTITION BY symbol ORDER BY bar_close ROWS 47 PRECEDING),
            w240 AS (PARTITION BY symbol ORDER BY bar_close ROWS 239 PRECEDING)""",
    "returns",
)
def realized_vol(t: Tables):
    """Sample deviation of lagged one-bar log returns over 8/48/240 bars."""

    def compute(d, w):
        d = with_cols(d, c1=F.lag("close").over(w))
        d = with_cols(d, r1=R.log_return(C("c1"), 1, w))
        return with_cols(
            d,
            realized_vol_8=R.std(C("r1"), 8, 4, w),
            realized_vol_48=R.std(C("r1"), 48, 24, w),
            realized_vol_240=R.std(C("r1"), 240, 120, w),
        )

    out = over_rows(bars_of(t, "close"), BAR, compute, lookback=242)
    return finish(out, "realized_vol_8", "realized_vol_48", "realized_vol_240")


@query(
    "vol_ratio",
    """WITH v AS (SELECT symbol, bar_close, CASE WHEN count(r1) OVER w8 >= 4 THEN stddev_samp(r1) OVER w8 END AS a,
              CASE WHEN count(r1) OVER w48 >= 24 THEN stddev_samp(r1) OVER w48 END AS b
       FROM returns WINDOW w8 AS (PARTITION BY symbol ORDER BY bar_close ROWS 7 PRECEDING),
            w48 AS (PARTITION BY symbol ORDER BY bar_close ROWS 47 PRECEDING))
       SELECT symbol, bar_close, round(a / nullif(b, 0), 6) AS vol_ratio_8_48 FROM v""",
    "returns",
)
def vol_ratio(t: Tables):
    """Short over long realised volatility."""

    def compute(d, w):
        d = with_cols(d, c1=F.lag("close").over(w))
        d = with_cols(d, r1=R.log_return(C("c1"), 1, w))
        return d.withColumn("vol_ratio_8_48", ratio(R.std(C("r1"), 8, 4, w), R.std(C("r1"), 48, 24, w)))

    return finish(over_rows(bars_of(t, "close"), BAR, compute, lookback=50), "vol_ratio_8_48")


@query(
    "rolling_z",
    """WITH v AS (SELECT *, CASE WHEN count(r1) OVER w48 >= 24 THEN stddev_samp(r1) OVER w48 END AS rv
                 FROM returns WINDOW w48 AS (PARTITION BY symbol ORDER BY bar_close ROWS 47 PRECEDING))
       SELECT symbol, bar_close,
              CASE WHEN count(rv) OVER w480 >= 120 THEN round((rv - avg(rv) OVER w480) / nullif(stddev_samp(rv) OVER w480, 0), 6) END AS vol_zscore_30d,
              CASE WHEN count(v1) OVER w20 >= 10 THEN round((v1 - avg(v1) OVER w20) / nullif(stddev_samp(v1) OVER w20, 0), 6) END AS volume_zscore
       FROM v WINDOW w480 AS (PARTITION BY symbol ORDER BY bar_close ROWS 479 PRECEDING),
                     w20 AS (PARTITION BY symbol ORDER BY bar_close ROWS 19 PRECEDING)""",
    "returns",
)
def rolling_z(t: Tables):
    """Rolling z-scores: volatility over 480 bars, volume over 20 bars."""

    def compute(d, w):
        d = with_cols(d, c1=F.lag("close").over(w), v1=F.lag("volume").over(w).cast("double"))
        d = with_cols(d, r1=R.log_return(C("c1"), 1, w))
        d = with_cols(d, rv=R.std(C("r1"), 48, 24, w))
        return with_cols(
            d, vol_zscore_30d=R.zscore(C("rv"), 480, 120, w), volume_zscore=R.zscore(C("v1"), 20, 10, w)
        )

    out = over_rows(bars_of(t, "close", "volume"), BAR, compute, lookback=530)
    return finish(out, "vol_zscore_30d", "volume_zscore")


@query(
    "pit_zscore",
    """SELECT symbol, bar_close, CASE WHEN count(close) OVER w >= 30 THEN
              round(greatest(least((close - avg(close) OVER w) / (stddev_samp(close) OVER w + 1e-8), 10.0), -10.0), 6) END AS z
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_close ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)""",
    "bars",
)
def pit_zscore(t: Tables):
    """z-score against statistics of the strictly earlier 1000 rows."""

    def compute(d, w):
        # The frame before a row is the trailing frame of the previous row.
        n, avg, var = R.moments(C("close"), 1000, w)
        d = with_cols(d, n_=n, m_=avg, s_=F.sqrt(var))
        prev = {c: F.lag(c).over(w) for c in ("n_", "m_", "s_")}
        z = (C("close") - prev["m_"]) / (prev["s_"] + F.lit(1e-8))
        return d.withColumn("z", F.when(prev["n_"] >= 30, clip(z, -10, 10)))

    return finish(over_rows(bars_of(t, "close"), BAR, compute, lookback=1001), "z")


@query(
    "garman_klass",
    """WITH g AS (SELECT symbol, bar_close, 0.5 * (ln(h1) - ln(l1)) ** 2 - (2 * ln(2) - 1) * (ln(c1) - ln(o1)) ** 2 AS gk FROM lagged)
       SELECT symbol, bar_close, CASE WHEN count(gk) OVER w >= 4 THEN round(sqrt(greatest(avg(gk) OVER w, 0)), 6) END AS garman_klass_8
       FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bar_close ROWS 7 PRECEDING)""",
    "lagged",
)
def garman_klass(t: Tables):
    """Garman-Klass volatility over 8 lagged bars."""

    def compute(d, w):
        d = with_cols(d, **{f"{f}1": F.lag(f).over(w) for f in ("open", "high", "low", "close")})
        gk = R.garman_klass(C("open1"), C("high1"), C("low1"), C("close1"), 8, 4, w)
        return d.withColumn("garman_klass_8", gk)

    return finish(over_rows(bars_of(t, "open", "high", "low", "close"), BAR, compute, lookback=8), "garman_klass_8")


BENCH = "view"

view(
    "benched",
    f"""SELECT a.symbol, a.bar_close, a.rn, a.c1, a.r1, b.r1 AS bench_r1, b.c1 AS bench_c1 FROM returns a
       ASOF LEFT JOIN (SELECT bar_close, r1, c1 FROM returns WHERE symbol = '{BENCH}') b ON a.bar_close >= b.bar_close""",
    "returns",
)


def benched(t: Tables) -> DataFrame:
    """Lagged close and return next to the benchmark symbol's latest ones."""

    def compute(d, w):
        d = with_cols(d, c1=F.lag("close").over(w))
        return with_cols(d, r1=R.log_return(C("c1"), 1, w))

    own = over_rows(bars_of(t, "close"), BAR, compute, lookback=2).drop("close")
    bench = own.filter(C("symbol") == BENCH).select(
        C("bar_close").alias("bench_close"), C("r1").alias("bench_r1"), C("c1").alias("bench_c1")
    )
    return asof_join(
        own, bench, left_time="bar_close", right_time="bench_close", strict=False, columns=["bench_r1", "bench_c1"]
    )


@query(
    "rolling_corr",
    """WITH p AS (SELECT symbol, bar_close, CASE WHEN bench_r1 IS NOT NULL THEN r1 END AS x, CASE WHEN r1 IS NOT NULL THEN bench_r1 END AS y FROM benched)
       SELECT symbol, bar_close, CASE WHEN count(x) OVER w >= 97 THEN round(corr(x, y) OVER w, 6) END AS corr_30d
       FROM p WINDOW w AS (PARTITION BY symbol ORDER BY bar_close ROWS 389 PRECEDING)""",
    "benched",
)
def rolling_corr(t: Tables):
    """390-bar correlation of a symbol's return with the benchmark's."""

    def compute(d, w):
        return d.withColumn("corr_30d", R.correlation(C("r1"), C("bench_r1"), 390, 97, w))

    return finish(over_rows(benched(t), BAR, compute, lookback=389), "corr_30d")


@query(
    "relative_strength",
    f"""WITH p AS (SELECT symbol, bar_close, r1 - bench_r1 AS d FROM benched)
       SELECT symbol, bar_close, CASE WHEN symbol = '{BENCH}' THEN 0.0 WHEN count(d) OVER w >= 12 THEN round(sum(d) OVER w, 6) END AS rs_24
       FROM p WINDOW w AS (PARTITION BY symbol ORDER BY bar_close ROWS 23 PRECEDING)""",
    "benched",
)
def relative_strength(t: Tables):
    """24-bar sum of own minus benchmark return; zero for the benchmark."""

    def compute(d, w):
        rs = R.total(C("r1") - C("bench_r1"), 24, 12, w)
        return d.withColumn("rs_24", F.when(C("symbol") == BENCH, F.lit(0.0)).otherwise(rs))

    return finish(over_rows(benched(t), BAR, compute, lookback=23), "rs_24")


@query(
    "asset_ratio",
    """WITH p AS (SELECT symbol, bar_close, bench_c1 / nullif(c1, 0) AS q FROM benched)
       SELECT symbol, bar_close, round(q, 6) AS ratio, round(ln(q) - ln(lag(q, 65) OVER w), 6) AS ratio_log_ret_5d
       FROM p WINDOW w AS (PARTITION BY symbol ORDER BY bar_close)""",
    "benched",
)
def asset_ratio(t: Tables):
    """Benchmark-to-asset price ratio and its 65-bar log change."""

    def compute(d, w):
        d = d.withColumn("ratio", ratio(C("bench_c1"), C("c1")))
        return d.withColumn("ratio_log_ret_5d", R.log_return(C("ratio"), 65, w))

    return finish(over_rows(benched(t), BAR, compute, lookback=65), "ratio", "ratio_log_ret_5d")


def ewm_sql(src: str, x: str, alpha: str, out: str, first: int = 1) -> str:
    """Closed form of the recursion for the checks: weights by row distance."""
    return f"""SELECT a.symbol, a.bar_close, a.rn, sum(power(1 - {alpha}, a.rn - b.rn) * CASE WHEN b.rn = {first} THEN 1 ELSE {alpha} END * b.{x}) AS {out}
       FROM {src} a JOIN {src} b ON a.symbol = b.symbol AND b.rn <= a.rn AND b.rn >= {first} GROUP BY 1, 2, 3"""


def ewm_args(*alphas: float, extra: int = 0) -> dict:
    """Halo (of other frames) and block size for exponential averages."""
    return {"lookback": extra, "block_rows": min(ewm_block(a, extra) for a in alphas)}


@query(
    "ewm_wilder",
    f"""WITH e AS ({ewm_sql('lagged', 'close', '(1 / 14.0::DOUBLE)', 'y')})
       SELECT symbol, bar_close, CASE WHEN rn >= 14 THEN round(y, 6) END AS ewm FROM e""",
    "lagged",
)
def ewm_wilder(t: Tables):
    """Recursive average with alpha 1/14 after 14 rows."""
    a = 1 / 14

    def compute(d, w):
        d = with_ewm(d, w, {"ewm": Ewm(C("close"), a)})
        return d.withColumn("ewm", F.when(C(POS) >= 14, C("ewm")))

    return finish(over_rows(bars_of(t, "close"), BAR, compute, **ewm_args(a)), "ewm")


@query(
    "ema",
    f"""WITH f AS ({ewm_sql('lagged', 'close', '(2 / 51.0::DOUBLE)', 'y')}), s AS ({ewm_sql('lagged', 'close', '(2 / 201.0::DOUBLE)', 'y')})
       SELECT f.symbol, f.bar_close, round(f.y, 6) AS ema_50, round(s.y, 6) AS ema_200 FROM f JOIN s USING (symbol, bar_close)""",
    "lagged",
)
def ema(t: Tables):
    """Exponential averages of span 50 and 200, seeded with the first close."""
    fast, slow = 2 / 51, 2 / 201

    def compute(d, w):
        return with_ewm(d, w, {"ema_50": Ewm(C("close"), fast), "ema_200": Ewm(C("close"), slow)})

    return finish(over_rows(bars_of(t, "close"), BAR, compute, **ewm_args(fast, slow)), "ema_50", "ema_200")


view(
    "atrs",
    f"""WITH tr AS (SELECT symbol, bar_close, rn, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr, close FROM lagged),
       e AS ({ewm_sql('tr', 'tr', '(1 / 14.0::DOUBLE)', 'y')})
       SELECT e.symbol, e.bar_close, e.rn, CASE WHEN e.rn >= 14 THEN e.y END AS atr FROM e""",
    "lagged",
)


def with_atr(d, w, out="atr"):
    tr = R.true_range(C("high"), C("low"), F.lag("close").over(w))
    d = d.withColumn("__tr", tr)
    d = with_ewm(d, w, {out: Ewm(C("__tr"), 1 / 14)})
    return d.withColumn(out, F.when(C(POS) >= 14, C(out))).drop("__tr")


@query("atr_14", "SELECT symbol, bar_close, round(atr, 6) AS atr_14 FROM atrs", "atrs")
def atr_14(t: Tables):
    """Average true range, Wilder smoothing over 14 bars."""
    bars = bars_of(t, "high", "low", "close")
    out = over_rows(bars, BAR, lambda d, w: with_atr(d, w, "atr_14"), **ewm_args(1 / 14, extra=1))
    return finish(out, "atr_14")


@query(
    "atr_barriers",
    """SELECT symbol, bar_close, CASE WHEN close > 0 THEN round(0.25 * atr / close, 6) END AS barrier_up,
              CASE WHEN close > 0 THEN round(0.25 * atr / close, 6) END AS barrier_down
       FROM atrs JOIN bars USING (symbol, bar_close)""",
    "atrs bars",
)
def atr_barriers(t: Tables):
    """Symmetric log-return barriers of a quarter ATR."""
    from pitspark.operators.labels import atr_barrier

    out = over_rows(bars_of(t, "high", "low", "close"), BAR, with_atr, **ewm_args(1 / 14, extra=1))
    b = atr_barrier(C("atr"), C("close"), 0.25)
    return finish(with_cols(out, barrier_up=b, barrier_down=b), "barrier_up", "barrier_down")


@query(
    "rsi_14",
    f"""WITH d AS (SELECT symbol, bar_close, rn, greatest(c1 - lag(c1) OVER w, 0) AS g, greatest(lag(c1) OVER w - c1, 0) AS l
                  FROM lagged WINDOW w AS (PARTITION BY symbol ORDER BY bar_close)),
       gg AS ({ewm_sql('d', 'g', '(1 / 14.0::DOUBLE)', 'y', 3)}), ll AS ({ewm_sql('d', 'l', '(1 / 14.0::DOUBLE)', 'y', 3)})
       SELECT b.symbol, b.bar_close, CASE WHEN b.rn >= 16 THEN round(100 * gg.y / nullif(gg.y + ll.y, 0), 6) END AS rsi_14
       FROM lagged b LEFT JOIN gg USING (symbol, bar_close) LEFT JOIN ll USING (symbol, bar_close)""",
    "lagged",
)
def rsi_14(t: Tables):
    """Relative strength index of the lagged close."""
    a = 1 / 14

    def compute(d, w):
        d = d.withColumn("c1", F.lag("close").over(w))
        d = d.withColumn("d1", R.diff(C("c1"), 1, w))
        zero = F.lit(0.0)
        up, down = F.greatest(C("d1"), zero), F.greatest(-C("d1"), zero)
        d = with_ewm(d, w, {"g": Ewm(up, a, 3), "l": Ewm(down, a, 3)})
        return d.withColumn("rsi_14", F.when(C(POS) >= 16, 100 * ratio(C("g"), C("g") + C("l"))))

    return finish(over_rows(bars_of(t, "close"), BAR, compute, **ewm_args(a, extra=2)), "rsi_14")


@query(
    "macd_signal",
    f"""WITH f AS ({ewm_sql('lagged', 'c1', '(2 / 13.0::DOUBLE)', 'y', 2)}), s AS ({ewm_sql('lagged', 'c1', '(2 / 27.0::DOUBLE)', 'y', 2)}),
       m AS (SELECT f.symbol, f.bar_close, f.rn, f.y - s.y AS macd FROM f JOIN s USING (symbol, bar_close)),
       g AS ({ewm_sql('m', 'macd', '(2 / 10.0::DOUBLE)', 'y', 2)})
       SELECT b.symbol, b.bar_close, round(m.macd, 6) AS macd, round(g.y, 6) AS macd_signal
       FROM lagged b LEFT JOIN m USING (symbol, bar_close) LEFT JOIN g USING (symbol, bar_close)""",
    "lagged",
)
def macd_signal(t: Tables):
    """12/26/9 moving-average convergence signal of the lagged close."""

    def compute(d, w):
        d = d.withColumn("c1", F.lag("close").over(w))
        d = with_ewm(d, w, {"fast": Ewm(C("c1"), 2 / 13, 2), "slow": Ewm(C("c1"), 2 / 27, 2)})
        d = d.withColumn("macd", C("fast") - C("slow"))
        return with_ewm(d, w, {"macd_signal": Ewm(C("macd"), 2 / 10, 2)})

    out = over_rows(bars_of(t, "close"), BAR, compute, **ewm_args(2 / 13, 2 / 27, 2 / 10, extra=1))
    return finish(out, "macd", "macd_signal")


@query(
    "bbands_pct",
    """SELECT symbol, bar_close, CASE WHEN count(c1) OVER w >= 20 THEN
              round((c1 - (avg(c1) OVER w - 2 * stddev_pop(c1) OVER w)) / nullif(4 * stddev_pop(c1) OVER w, 0), 6) END AS bbands_pct
       FROM lagged WINDOW w AS (PARTITION BY symbol ORDER BY bar_close ROWS 19 PRECEDING)""",
    "lagged",
)
def bbands_pct(t: Tables):
    """Position of the lagged close inside its 20-bar two-sigma band."""

    def compute(d, w):
        d = d.withColumn("c1", F.lag("close").over(w))
        return d.withColumn("bbands_pct", R.percent_b(C("c1"), 20, 2.0, w))

    return finish(over_rows(bars_of(t, "close"), BAR, compute, lookback=20), "bbands_pct")


@query(
    "bar_shape",
    """SELECT symbol, bar_close, CASE WHEN count(h1 - l1) OVER w >= 4 THEN round(avg(h1 - l1) OVER w, 6) END AS high_low_range,
              round(c1 / nullif(o1, 0) - 1, 6) AS close_open_ratio
       FROM lagged WINDOW w AS (PARTITION BY symbol ORDER BY bar_close ROWS 7 PRECEDING)""",
    "lagged",
)
def bar_shape(t: Tables):
    """Mean lagged range over 8 bars and lagged close/open - 1."""

    def compute(d, w):
        d = with_cols(d, **{f"{f}1": F.lag(f).over(w) for f in ("open", "high", "low", "close")})
        return with_cols(
            d,
            high_low_range=R.mean(C("high1") - C("low1"), 8, 4, w),
            close_open_ratio=ratio(C("close1"), C("open1")) - 1,
        )

    out = over_rows(bars_of(t, "open", "high", "low", "close"), BAR, compute, lookback=8)
    return finish(out, "high_low_range", "close_open_ratio")


@query(
    "time_rolling_mean",
    """SELECT event_id, symbol, round(avg(price) OVER (PARTITION BY symbol ORDER BY ts
              RANGE BETWEEN INTERVAL '4 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW), 6) AS mean_5min FROM ticks""",
    "ticks",
)
def time_rolling_mean(t: Tables):
    """Mean over the trailing five minutes (t - 5 min, t] per symbol."""
    key = SeriesKey(("symbol",), "ts", ("event_id",), DAY)

    def compute(d, w):
        frame = w.rangeBetween(-(300_000_000 - 1), 0)
        return d.withColumn("mean_5min", rnd(F.avg("price").over(frame)))

    return over_time(t.ticks, key, compute, seconds=300).select("event_id", "symbol", "mean_5min")


@query(
    "forward_fill",
    """SELECT symbol, bar_close, last_value(CASE WHEN volume >= 4 THEN close END IGNORE NULLS) OVER
              (PARTITION BY symbol ORDER BY bar_close ROWS UNBOUNDED PRECEDING) AS filled FROM bars""",
    "bars",
)
def forward_fill(t: Tables):
    """Last close of a busy bar carried forward."""
    sparse = F.when(C("volume") >= 4, C("close"))
    out = running(bars_of(t, "close", "volume"), BAR, [Running("filled", "last", sparse)])
    return out.select(*KEY, "filled")


@query(
    "donchian_channel",
    """SELECT symbol, bar_close, CASE WHEN count(*) OVER w >= 20 THEN max(high) OVER w END AS upper,
              CASE WHEN count(*) OVER w >= 20 THEN min(low) OVER w END AS lower
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_close ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "bars",
)
def donchian_channel(t: Tables):
    """Highest high and lowest low of the 20 bars before the current one."""

    def compute(d, w):
        hi, lo = R.channel(C("high"), C("low"), 20, w)
        return with_cols(d, upper=hi, lower=lo)

    return over_rows(bars_of(t, "high", "low"), BAR, compute, lookback=20).select(*KEY, "upper", "lower")


# Row lag of the yearly change per test series (quarterly, monthly, weekly, daily).
YOY = {"1-URGENT": 4, "2-HIGH": 12, "3-MEDIUM": 52, "4-NOT SPECIFIED": 260, "5-LOW": 12}


@query(
    "yoy_mom",
    """SELECT series_id, date, value AS level,
              round(value / nullif(CASE series_id WHEN '1-URGENT' THEN lag(value, 4) OVER w WHEN '3-MEDIUM' THEN lag(value, 52) OVER w
                    WHEN '4-NOT SPECIFIED' THEN lag(value, 260) OVER w ELSE lag(value, 12) OVER w END, 0) - 1, 6) AS yoy_change,
              round(value / nullif(lag(value) OVER w, 0) - 1, 6) AS mom_change
       FROM firsts WINDOW w AS (PARTITION BY series_id ORDER BY date)""",
    "firsts",
)
def yoy_mom(t: Tables):
    """Yearly and one-step change with a series-specific row lag."""
    first = latest_by(t.vintages, ["series_id", "date"], order=["realtime_start"], pick=["value"], first=True)

    def compute(d, w):
        past = F.lit(None).cast("double")
        for p in sorted(set(YOY.values())):
            mine = C("series_id").isin([s for s, q in YOY.items() if q == p])
            past = F.when(mine, F.lag("value", p).over(w)).otherwise(past)
        return with_cols(
            d,
            yoy_change=rnd(ratio(C("value"), past) - 1),
            mom_change=rnd(ratio(C("value"), F.lag("value").over(w)) - 1),
        )

    out = over_rows(first, SERIES, compute, lookback=max(YOY.values()))
    return out.select("series_id", "date", C("value").alias("level"), "yoy_change", "mom_change")


@query(
    "curve_spreads",
    """WITH a AS (SELECT date, t_visible, value FROM firsts WHERE series_id = '1-URGENT'),
            b AS (SELECT date AS bdate, t_visible AS bvis, value AS bvalue FROM firsts WHERE series_id = '5-LOW')
       SELECT a.date, greatest(a.t_visible, b.bvis) AS t_visible, round(a.value / 10.0, 6) AS level_10, round(a.value / 30.0, 6) AS level_30,
              round(a.value - b.bvalue, 6) AS term_spread, round(a.value - 100 * b.bvalue / 1000.0, 6) AS real_rate
       FROM a ASOF LEFT JOIN b ON a.date >= b.bdate""",
    "firsts",
)
def curve_spreads(t: Tables):
    """Scaled levels and spreads against the latest value of a second series."""
    first = latest_by(
        t.vintages, ["series_id", "date"], order=["realtime_start"], pick=["value", "t_visible"], first=True
    )
    a = first.filter(C("series_id") == "1-URGENT")
    b = first.filter(C("series_id") == "5-LOW").select(
        C("date").alias("bdate"), C("t_visible").alias("bvis"), C("value").alias("bvalue")
    )
    j = asof_join(
        a, b, left_time="date", right_time="bdate", strict=False, columns=["bvis", "bvalue"], bucket_seconds=365 * DAY
    )
    return j.select(
        "date",
        F.greatest("t_visible", "bvis").alias("t_visible"),
        rnd(C("value") / 10.0).alias("level_10"),
        rnd(C("value") / 30.0).alias("level_30"),
        rnd(C("value") - C("bvalue"), 6).alias("term_spread"),
        rnd(C("value") - 100 * C("bvalue") / 1000.0, 6).alias("real_rate"),
    )


@query(
    "net_positioning",
    """WITH p AS (SELECT contract, report_date, total, longs - shorts AS net FROM positions_book)
       SELECT contract, report_date, net, round(net / nullif(total, 0), 6) AS net_pct_oi,
              CASE WHEN count(net) OVER w >= 20 THEN round((net - avg(net) OVER w) / nullif(stddev_samp(net) OVER w, 0), 6) END AS z_52w,
              net - lag(net) OVER o AS wow_change
       FROM p WINDOW o AS (PARTITION BY contract ORDER BY report_date), w AS (PARTITION BY contract ORDER BY report_date ROWS 51 PRECEDING)""",
    "positions_book",
)
def net_positioning(t: Tables):
    """Net position, share of open interest, 52-row z-score, change."""

    def compute(d, w):
        return with_cols(
            d,
            net_pct_oi=rnd(ratio(C("net"), C("total"))),
            z_52w=rnd(R.zscore(C("net"), 52, 20, w)),
            wow_change=R.diff(C("net"), 1, w),
        )

    book = t.positions_book.withColumn("net", C("longs") - C("shorts"))
    return over_rows(book, BOOK, compute, lookback=51).select(
        "contract", "report_date", "net", "net_pct_oi", "z_52w", "wow_change"
    )


@query(
    "irregular_gap",
    """SELECT contract, report_date, coalesce(date_diff('day', lag(report_date) OVER w, report_date) > 31
              OR date_diff('day', lag(report_date) OVER w, report_date) < 28, false) AS irregular
       FROM positions_book WINDOW w AS (PARTITION BY contract ORDER BY report_date)""",
    "positions_book",
)
def irregular_gap(t: Tables):
    """Flag reports whose distance from the previous one is unusual."""
    from pitspark.operators.quality import irregular_gap as gap

    out = over_rows(
        t.positions_book,
        BOOK,
        lambda d, w: d.withColumn("irregular", gap(C("report_date"), w, lo_days=28, hi_days=31)),
        lookback=1,
    )
    return out.select("contract", "report_date", "irregular")


@query(
    "stock_to_flow",
    """WITH p AS (SELECT contract, report_date, total, CASE WHEN contract % 2 = 0 THEN longs - shorts END AS flow FROM positions_book),
       n AS (SELECT *, CASE WHEN max(flow IS NOT NULL) OVER (PARTITION BY contract) THEN flow
                       ELSE total - lag(total) OVER (PARTITION BY contract ORDER BY report_date) END AS net FROM p)
       SELECT contract, report_date, net, net - lag(net, 4) OVER (PARTITION BY contract ORDER BY report_date) AS yoy,
              CASE WHEN net IS NOT NULL THEN CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS is_buyer
       FROM n""",
    "positions_book",
)
def stock_to_flow(t: Tables):
    """Reported flow, or the change of holdings where no flow is reported."""
    p = t.positions_book.withColumn("flow", F.when(C("contract") % 2 == 0, C("longs") - C("shorts")))
    # Whether a series reports flows at all is one row per series.
    has = p.groupBy("contract").agg((F.count("flow") > 0).alias("has_flow"))

    def compute(d, w):
        net = F.when(C("has_flow"), C("flow")).otherwise(R.diff(C("total"), 1, w))
        d = d.withColumn("net", net)
        flag = F.when(C("net").isNotNull(), (C("net") > 0).cast("double"))
        return with_cols(d, yoy=R.diff(C("net"), 4, w), is_buyer=flag)

    return over_rows(p.join(has, "contract"), BOOK, compute, lookback=5).select(
        "contract", "report_date", "net", "yoy", "is_buyer"
    )


@query(
    "index_features",
    """SELECT contract, report_date, total AS level, total - lag(total) OVER o AS mom, total - lag(total, 12) OVER o AS yoy,
              CASE WHEN count(total) OVER w >= 24 THEN round((total - avg(total) OVER w) / nullif(stddev_samp(total) OVER w, 0), 6) END AS z_60
       FROM positions_book WINDOW o AS (PARTITION BY contract ORDER BY report_date),
            w AS (PARTITION BY contract ORDER BY report_date ROWS 59 PRECEDING)""",
    "positions_book",
)
def index_features(t: Tables):
    """Level, 1- and 12-step difference and 60-step z-score."""

    def compute(d, w):
        x = C("total")
        return with_cols(d, mom=R.diff(x, 1, w), yoy=R.diff(x, 12, w), z_60=rnd(R.zscore(x, 60, 24, w)))

    return over_rows(t.positions_book, BOOK, compute, lookback=59).select(
        "contract", "report_date", C("total").alias("level"), "mom", "yoy", "z_60"
    )


@query(
    "trend_seasonal",
    """WITH f AS (SELECT symbol, bar_close, close, first_value(close) OVER o AS x0, sum(close) OVER w AS s, count(*) OVER w AS n
                 FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY bar_close), w AS (PARTITION BY symbol ORDER BY bar_close ROWS 23 PRECEDING))
       SELECT symbol, bar_close, round((s + (24 - n) * x0) / 24.0, 6) AS trend, round(close - (s + (24 - n) * x0) / 24.0, 6) + 0.0 AS seasonal FROM f""",
    "bars",
)
def trend_seasonal(t: Tables):
    """Causal 24-bar trend (left edge repeated) and what remains."""
    bars = bars_of(t, "close")
    first = latest_by(bars, ["symbol"], order=["bar_close"], pick=["close"], first=True).select(
        "symbol", C("close").alias("x0")
    )

    def compute(d, w):
        d = d.withColumn("trend", R.causal_trend(C("close"), 24, C("x0"), w))
        return d.withColumn("seasonal", C("close") - C("trend"))

    return finish(over_rows(bars.join(first, "symbol"), BAR, compute, lookback=23), "trend", "seasonal")


@query(
    "window_norm",
    """SELECT symbol, bar_close, round(avg(close) OVER w, 9) AS mu, round(stddev_pop(close) OVER w, 6) AS sigma,
              round((close - avg(close) OVER w) / sqrt(var_pop(close) OVER w + 1e-5), 6) AS normed
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_close ROWS 63 PRECEDING)""",
    "bars",
)
def window_norm(t: Tables):
    """Per-window standardisation with the statistics kept for the inverse."""

    def compute(d, w):
        f = trailing(w, 64)
        mu, var = F.avg("close").over(f), F.var_pop("close").over(f)
        return with_cols(d, mu=mu, sigma=F.sqrt(var), normed=(C("close") - mu) / F.sqrt(var + F.lit(1e-5)))

    out = over_rows(bars_of(t, "close"), BAR, compute, lookback=63)
    return out.select(*KEY, rnd(C("mu"), 9).alias("mu"), rnd(C("sigma")).alias("sigma"), rnd(C("normed")).alias("normed"))


@query(
    "lookback_windows",
    """WITH x AS (SELECT symbol, bar_close, array_agg(round(close * 100)::BIGINT) OVER w AS win, lead(close) OVER o AS nxt
                 FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY bar_close),
                 w AS (PARTITION BY symbol ORDER BY bar_close ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING))
       SELECT symbol, bar_close, array_to_string(win, '|') AS lookback FROM x WHERE len(win) = 64 AND nxt IS NOT NULL""",
    "bars",
)
def lookback_windows(t: Tables):
    """The 64 closes before each bar that has full history and a next bar."""

    def compute(d, w):
        prior = w.rowsBetween(-64, -1)
        return with_cols(
            d,
            win=F.collect_list(F.round(C("close") * 100).cast("long")).over(prior),
            nxt=F.lead("close").over(w),
        )

    out = over_rows(bars_of(t, "close"), BAR, compute, lookback=64, lookahead=1)
    full = out.filter((F.size("win") == 64) & C("nxt").isNotNull())
    return full.select(*KEY, F.array_join("win", "|").alias("lookback"))


