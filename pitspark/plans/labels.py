"""Labels, folds and regimes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitspark.functions import sessions as S
from pitspark.functions.mathfn import clip, ratio, rnd, safe_ln
from pitspark.operators import folds as FO
from pitspark.operators import labels as L
from pitspark.operators import regimes as G
from pitspark.operators import rolling as R
from pitspark.operators.asof import asof_join, event_within, nearest_events
from pitspark.operators.chunked import Ewm, SeriesKey, ewm_block, over_rows, over_time, POS, with_ewm
from pitspark.operators.ranks import exact_quantiles
from pitspark.operators.versions import latest_by
from pitspark.plans.aggregates import labelled, rv60
from pitspark.plans.registry import query, view
from pitspark.plans.series import ewm_sql
from pitspark.session import materialise
from pitspark.sources.views import BAR, DAILY, DAY, Tables

C = F.col


@query("label_fixed", "SELECT symbol, bar_close, round(nr, 6) AS next_return, label::BIGINT AS label FROM labelled", "labelled")
def label_fixed(t: Tables):
    """Next return against a fixed threshold."""
    return labelled(t).select("symbol", "bar_close", rnd(C("next_return")).alias("next_return"), "label")


view(
    "bars30",
    """SELECT symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS bar_open, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS bar_close,
              last(price ORDER BY ts, event_id) AS close FROM ticks GROUP BY 1, 2, 3""",
    "ticks",
)
_ET = "AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'"


def session_momentum(d, *, idx: int = 4):
    """Return of one session bar carried to the later bars of its day; groups
    are single sessions."""
    day = W.partitionBy("symbol", "__day")
    d = d.withColumn("__day", S.session_date(C("bar_open"))).withColumn("__i", S.session_bar_index(C("bar_open")))
    d = d.withColumn("h5", F.max(F.when(C("__i") == idx, C("ret"))).over(day))
    return d.withColumn("h5", F.when(C("__i") >= idx, C("h5"))).drop("__day", "__i")


def half_hour(t: Tables):
    def compute(d, w):
        d = d.withColumn("ret", R.log_return(C("close"), 1, w))
        return d.withColumn("rv", R.std(C("ret"), 60, 60, w))

    return over_rows(t.bars30.select("symbol", "bar_open", "bar_close", "close"), BAR, compute, lookback=60)


view(
    "half",
    f"""SELECT *, CASE WHEN count(ret) OVER w >= 60 THEN stddev_samp(ret) OVER w END AS rv FROM
        (SELECT symbol, bar_open, bar_close, close, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY bar_close)) AS ret,
         ((bar_open {_ET})::DATE AS day, hour((bar_open {_ET}) * 60 + minute((bar_open {_ET}) AS m FROM bars30)
        WINDOW w AS (PARTITION BY symbol ORDER BY bar_close ROWS 59 PRECEDING)""",
    "bars30",
)
view(
    "h5s",
    """SELECT symbol, bar_open, bar_close, day, rv, close, CASE WHEN m >= 690 AND m < 960 THEN
              max(CASE WHEN m >= 690 AND m < 720 THEN ret END) OVER (PARTITION BY symbol, day) END AS h5 FROM half""",
    "half",
)


@query(
    "session_bar_momentum",
    """WITH q AS (SELECT symbol, quantile_cont(rv, 2 / 3.0::DOUBLE) AS thr FROM half WHERE bar_close < TIMESTAMP '2024-01-20' AND rv IS NOT NULL GROUP BY 1)
       SELECT h.symbol, h.bar_close, round(h5, 6) AS h5_return, round(coalesce(h5, 0) * coalesce((rv > thr)::INT, 0), 6) + 0.0 AS h5_x_vol_high
       FROM h5s h LEFT JOIN q USING (symbol)""",
    "h5s",
)
def session_bar_momentum(t: Tables):
    """Fifth half-hour return, plain and gated by a train-fitted volatility cut."""
    half = half_hour(t)
    train = half.filter(C("bar_close") < F.lit("2024-01-20").cast("timestamp_ntz"))
    cut = exact_quantiles(train, ["symbol"], "rv", {"thr": 2 / 3}).select("symbol", "thr")
    out = session_momentum(half).join(cut, "symbol", "left")
    high = F.coalesce((C("rv") > C("thr")).cast("double"), F.lit(0.0))
    return out.select(
        "symbol",
        "bar_close",
        rnd(C("h5")).alias("h5_return"),
        rnd(F.coalesce(C("h5"), F.lit(0.0)) * high).alias("h5_x_vol_high"),
    )


PROXY_SCALE = 0.2


def proxy_spread():
    """High-low spread proxy in basis points."""
    return ratio(C("high") - C("low"), F.when(C("close") > 0, C("close"))) * 10_000.0 * PROXY_SCALE


@query(
    "spread_proxy",
    """WITH q AS (SELECT symbol, ts, event_id, avg(price / 5) OVER (PARTITION BY symbol ORDER BY ts
                  RANGE BETWEEN INTERVAL '4 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW) AS s FROM ticks),
       u AS (SELECT symbol, ts, arg_max(s, event_id) AS s FROM q GROUP BY 1, 2)
       SELECT b.symbol, b.bar_close, round(least(greatest(coalesce(u.s, (high - low) / nullif(close, 0) * 10000.0 * 0.2), 0), 200), 6)::DOUBLE AS spread_bps
       FROM bars b ASOF LEFT JOIN u ON b.symbol = u.symbol AND b.bar_close > u.ts""",
    "bars",
)
def spread_proxy(t: Tables):
    """Five-minute mean quote spread before the bar, else a range proxy."""
    key = SeriesKey(("symbol",), "ts", ("event_id",), DAY)

    def compute(d, w):
        return d.withColumn("s", F.avg(C("price") / 5).over(w.rangeBetween(-(300_000_000 - 1), 0)))

    smooth = over_time(t.ticks, key, compute, seconds=300)
    j = asof_join(
        t.bars.select("symbol", "bar_close", "high", "low", "close"),
        smooth,
        left_time="bar_close",
        right_time="ts",
        strict=True,
        columns=["s"],
        by=["symbol"],
        tie=["event_id"],
    )
    return j.select("symbol", "bar_close", rnd(clip(F.coalesce("s", proxy_spread()), 0, 200)).alias("spread_bps"))


def barrier_labels(bars, key: SeriesKey):
    """Triple-barrier label of each bar (quarter ATR, range-proxy spread)."""
    a = 1 / 14

    def compute(d, w):
        d = d.withColumn("__tr", R.true_range(C("high"), C("low"), F.lag("close").over(w)))
        d = with_ewm(d, w, {"__atr": Ewm(C("__tr"), a)})
        atr = F.when(C(POS) >= 14, C("__atr"))
        d = d.withColumn("barrier", L.atr_barrier(atr, C("close")))
        nxt = safe_ln(F.lead("close").over(w)) - safe_ln(C("close"))
        return d.withColumn("next_return", nxt).drop("__tr", "__atr")

    out = over_rows(bars, key, compute, lookback=1, lookahead=1, block_rows=ewm_block(a, 2))
    spread = clip(proxy_spread(), 0, 200)
    return out.withColumn("label", L.triple_barrier_label(C("next_return"), C("barrier"), C("barrier"), spread))


_TB = """CASE WHEN nr IS NULL OR atr IS NULL OR close <= 0 OR atr <= 0 THEN 0 WHEN abs(nr) < least(greatest((high - low) / close * 2000.0, 0), 200) / 10000.0 THEN 0
              WHEN nr >= 0.25 * atr / close THEN 1 WHEN nr <= -0.25 * atr / close THEN -1 ELSE 0 END"""


@query(
    "label_triple_barrier",
    f"""WITH n AS (SELECT b.symbol, b.bar_close, high, low, close, atr, ln(lead(close) OVER (PARTITION BY b.symbol ORDER BY b.bar_close)) - ln(close) AS nr
                   FROM bars b JOIN atrs USING (symbol, bar_close))
        SELECT symbol, bar_close, ({_TB})::BIGINT AS label, ({_TB} + 1)::BIGINT AS class_index FROM n""",
    "bars atrs",
)
def label_triple_barrier(t: Tables):
    """Barrier label and its class index."""
    out = barrier_labels(t.bars.select("symbol", "bar_close", "high", "low", "close"), BAR)
    return out.select("symbol", "bar_close", "label", L.to_class_index(C("label")).alias("class_index"))


@query(
    "label_split",
    """SELECT symbol, bar_close, CASE WHEN bar_close > TIMESTAMP '2000-06-30' THEN 'test' WHEN bar_close > TIMESTAMP '1999-06-30' THEN 'val' ELSE 'train' END AS split FROM daily""",
    "daily",
)
def label_split(t: Tables):
    """Calendar split of each bar."""
    return t.daily.select("symbol", "bar_close", L.calendar_split(C("bar_close"), "1999-06-30", "2000-06-30").alias("split"))


view(
    "fold0",
    """SELECT symbol, n::BIGINT AS fold, min(bar_close) AS lo, max(bar_close) AS hi FROM daily, range(4) r(n) GROUP BY 1, 2""",
    "daily",
)
view("fold1", "SELECT *, lo + to_months((3 * fold)::INT) AS train_start FROM fold0", "fold0")
view("fold2", "SELECT *, train_start + INTERVAL 36 MONTH AS train_end FROM fold1", "fold1")
view("fold3", "SELECT *, train_end + INTERVAL 7 DAY AS val_start FROM fold2", "fold2")
view("fold4", "SELECT *, val_start + INTERVAL 6 MONTH AS val_end FROM fold3", "fold3")
view("fold5", "SELECT *, val_end + INTERVAL 7 DAY AS test_start FROM fold4", "fold4")
view(
    "foldtab",
    "SELECT * FROM (SELECT *, test_start + INTERVAL 6 MONTH AS test_end FROM fold5) WHERE test_end <= hi",
    "fold5",
)
view(
    "folded",
    """SELECT d.*, f.fold, CASE WHEN bar_close >= train_start AND bar_close < train_end THEN 'train' WHEN bar_close >= val_start AND bar_close < val_end THEN 'val'
              WHEN bar_close >= test_start AND bar_close < test_end THEN 'test' END AS role FROM daily d JOIN foldtab f USING (symbol)""",
    "daily foldtab",
)


def folded(t: Tables, df):
    folds = FO.fold_table(t.daily, ["symbol"], "bar_close")
    return FO.assign_folds(df, folds, ["symbol"], "bar_close")


@query("walk_forward_folds", "SELECT symbol, bar_close, fold, role FROM folded WHERE role IS NOT NULL", "folded")
def walk_forward_folds(t: Tables):
    """Each daily bar in every fold it belongs to, with its role."""
    return folded(t, t.daily.select("symbol", "bar_close"))


@query(
    "fold_violations",
    """SELECT f.symbol, f.fold, f.train_start, f.test_end, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'val') AS n_val,
              count(*) FILTER (WHERE role = 'test') AS n_test,
              any_value(train_end <= val_start AND val_end <= test_start) AND count(*) FILTER (WHERE role = 'train') > 0
              AND count(*) FILTER (WHERE role = 'val') > 0 AND count(*) FILTER (WHERE role = 'test') > 0 AS ok
       FROM foldtab f JOIN folded d ON d.symbol = f.symbol AND d.fold = f.fold GROUP BY 1, 2, 3, 4""",
    "folded foldtab",
)
def fold_violations(t: Tables):
    """Fold bounds, sizes and sanity."""
    folds = FO.fold_table(t.daily, ["symbol"], "bar_close")
    sizes = FO.fold_sizes(FO.assign_folds(t.daily.select("symbol", "bar_close"), folds, ["symbol"], "bar_close"), ["symbol"])
    return FO.malformed(folds, sizes, ["symbol"]).select(
        "symbol", "fold", "train_start", "test_end", "n_train", "n_val", "n_test", "ok"
    )


@query(
    "val_subsplit",
    """WITH v AS (SELECT symbol, fold, bar_close, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol, fold) AS n FROM folded WHERE role = 'val'
                 WINDOW w AS (PARTITION BY symbol, fold ORDER BY bar_close))
       SELECT symbol, fold, bar_close, CASE WHEN i < n // 2 THEN 'a' WHEN i < n // 2 + n // 4 THEN 'b' ELSE 'c' END AS val_slice FROM v""",
    "folded",
)
def val_subsplit(t: Tables):
    """Chronological 50/25/25 slices of each validation window."""
    val = folded(t, t.daily.select("symbol", "bar_close")).filter(C("role") == "val")
    out = FO.split_validation(val, SeriesKey(("symbol", "fold"), "bar_close", (), 365 * DAY))
    return out.select("symbol", "fold", "bar_close", "val_slice")


_CUTS = """SELECT symbol, quantile_cont({x}, 1 / 3.0::DOUBLE) AS {p}_t1, quantile_cont({x}, 2 / 3.0::DOUBLE) AS {p}_t2
           FROM {src} WHERE bar_close < TIMESTAMP '1999-01-01' AND {x} IS NOT NULL GROUP BY 1"""


@query(
    "tercile_onehot",
    f"""WITH q AS ({_CUTS.format(x='rv', p='rv', src='rv60')})
        SELECT r.symbol, bar_close, coalesce(rv <= rv_t1, false)::BIGINT AS low, coalesce(rv > rv_t1 AND rv <= rv_t2, false)::BIGINT AS mid,
               coalesce(rv > rv_t2, false)::BIGINT AS high FROM rv60 r LEFT JOIN q USING (symbol)""",
    "rv60",
)
def tercile_onehot(t: Tables):
    """Volatility terciles with cuts fitted before a date."""
    rv = rv60(t)
    cuts = G.fit_terciles(rv.filter(C("bar_close") < F.lit("1999-01-01").cast("timestamp_ntz")), ["symbol"], "rv")
    low, mid, high = G.tercile_flags(C("rv"), C("rv_t1"), C("rv_t2"))
    return rv.join(cuts, "symbol", "left").select(
        "symbol", "bar_close", low.alias("low"), mid.alias("mid"), high.alias("high")
    )


view(
    "vixed",
    """SELECT r.symbol, r.bar_close, r.rv, v.value / 30.0 AS vix FROM rv60 r ASOF LEFT JOIN
       (SELECT t_visible, arg_max(value, date) AS value FROM firsts WHERE series_id = '1-URGENT' GROUP BY 1) v ON r.bar_close > v.t_visible""",
    "rv60 firsts",
)


@query(
    "regime_vector",
    f"""WITH q AS ({_CUTS.format(x='rv', p='rv', src='vixed')}), p AS ({_CUTS.format(x='vix', p='vix', src='vixed')}),
        ev AS (SELECT event_ts FROM schedule WHERE event_type = 'NFP')
        SELECT r.symbol, bar_close, coalesce(vix <= vix_t1, false)::BIGINT AS regime_vix_low, coalesce(vix > vix_t1 AND vix <= vix_t2, false)::BIGINT AS regime_vix_mid,
               coalesce(vix > vix_t2, false)::BIGINT AS regime_vix_high, coalesce(rv <= rv_t1, false)::BIGINT AS regime_rv_low,
               coalesce(rv > rv_t1 AND rv <= rv_t2, false)::BIGINT AS regime_rv_mid, coalesce(rv > rv_t2, false)::BIGINT AS regime_rv_high,
               EXISTS (SELECT 1 FROM ev WHERE event_ts BETWEEN bar_close - INTERVAL 3 DAY AND bar_close + INTERVAL 3 DAY)::BIGINT AS regime_event_week,
               (year(bar_close) BETWEEN 2016 AND 2019)::BIGINT AS regime_year_2016_2019, (year(bar_close) BETWEEN 2020 AND 2022)::BIGINT AS regime_year_2020_2022,
               (year(bar_close) BETWEEN 2023 AND 2024)::BIGINT AS regime_year_2023_2024, (year(bar_close) >= 2025)::BIGINT AS regime_year_2025_plus
        FROM vixed r LEFT JOIN q USING (symbol) LEFT JOIN p USING (symbol)""",
    "vixed schedule",
)
def regime_vector(t: Tables):
    """Deterministic regime flags in their fixed order."""
    level = latest_by(
        t.vintages.filter(C("series_id") == "1-URGENT"), ["date"], order=["realtime_start"], pick=["value", "t_visible"], first=True
    )
    base = asof_join(
        rv60(t).select("symbol", "bar_close", "rv"), level, left_time="bar_close", right_time="t_visible", strict=True,
        columns=["value"], tie=["date"], bucket_seconds=90 * DAY,
    )
    nfp = t.schedule.filter(C("event_type") == "NFP").select("event_ts")
    base = nearest_events(
        base.withColumn("vix", C("value") / 30.0), nfp, left_time="bar_close", event_time="event_ts", bucket_seconds=90 * DAY
    )
    base = materialise(base.withColumn("week", event_within(C("prev_event"), C("next_event"), C("bar_close"), 3 * DAY)))
    train = base.filter(C("bar_close") < F.lit("1999-01-01").cast("timestamp_ntz"))
    cuts = G.fit_terciles(train, ["symbol"], "vix").join(G.fit_terciles(train, ["symbol"], "rv"), "symbol", "full")
    out = G.regime_columns(
        base, cuts, ["symbol"], levels={"vix": "vix", "rv": "rv"}, event_week=C("week"), time=C("bar_close")
    )
    return out.select("symbol", "bar_close", *[c for c in out.columns if c.startswith("regime_")])


def volatility_rows(t: Tables):
    def compute(d, w):
        d = d.withColumn("ret", R.log_return(C("close"), 1, w))
        return d.withColumn("rv", R.std(C("ret"), 60, 60, w))

    return folded(t, over_rows(t.daily.select("symbol", "bar_close", "close"), DAILY, compute, lookback=60))


@query("vol_state_posterior")
def vol_state_posterior(t: Tables):
    """High-volatility probability per fold and bar: chain fitted by EM."""
    out = G.volatility_posterior(materialise(volatility_rows(t)), fold="fold", key=DAILY, train=C("role") == "train", ret="ret", rv="rv", out="p_high_vol")
    return out.select("symbol", "fold", "bar_close", rnd(C("p_high_vol"), 4).alias("p_high_vol"))


@query(
    "vol_state_filter",
    """WITH RECURSIVE x AS (SELECT d.symbol, d.fold, d.bar_close, d.role, abs(r.ret) AS a, v.rv, a IS NOT NULL AND v.rv IS NOT NULL AS ok
          FROM folded d JOIN rv60 v USING (symbol, bar_close)
          JOIN (SELECT symbol, bar_close, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY bar_close)) AS ret FROM daily) r USING (symbol, bar_close) WHERE d.role IS NOT NULL),
       tr AS (SELECT symbol, fold, bar_close, a, rv, (rv > avg(rv) OVER (PARTITION BY fold))::INT AS s FROM x WHERE ok AND role = 'train'),
       l AS (SELECT *, lag(s) OVER (PARTITION BY symbol, fold ORDER BY bar_close) AS q FROM tr),
       p AS (SELECT fold, avg(a) FILTER (WHERE s = 0) AS ma0, avg(rv) FILTER (WHERE s = 0) AS mr0, var_pop(a) FILTER (WHERE s = 0) AS va0, var_pop(rv) FILTER (WHERE s = 0) AS vr0,
               avg(a) FILTER (WHERE s = 1) AS ma1, avg(rv) FILTER (WHERE s = 1) AS mr1, var_pop(a) FILTER (WHERE s = 1) AS va1, var_pop(rv) FILTER (WHERE s = 1) AS vr1,
               (count(*) FILTER (WHERE q = 0 AND s = 1) + 1) / (count(*) FILTER (WHERE q = 0) + 2)::DOUBLE AS up,
               (count(*) FILTER (WHERE q = 1 AND s = 1) + 1) / (count(*) FILTER (WHERE q = 1) + 2)::DOUBLE AS stay FROM l GROUP BY 1 HAVING count(*) >= 200),
       lik AS (SELECT symbol, fold, bar_close, row_number() OVER (PARTITION BY symbol, fold ORDER BY bar_close) AS rn, up, stay,
               -0.5 * ((a - ma0) ** 2 / va0 + ln(va0) + (rv - mr0) ** 2 / vr0 + ln(vr0)) AS l0, -0.5 * ((a - ma1) ** 2 / va1 + ln(va1) + (rv - mr1) ** 2 / vr1 + ln(vr1)) AS l1
               FROM x JOIN p USING (fold) WHERE ok),
       e AS MATERIALIZED (SELECT symbol, fold, bar_close, rn, up, stay, exp(l0 - greatest(l0, l1)) AS e0, exp(l1 - greatest(l0, l1)) AS e1 FROM lik),
       f AS (SELECT symbol, fold, rn, e1 / (e0 + e1) AS p1 FROM e WHERE rn = 1
         UNION ALL SELECT e.symbol, e.fold, e.rn, e1 * ((1 - p1) * up + p1 * stay) / (e0 * ((1 - p1) * (1 - up) + p1 * (1 - stay)) + e1 * ((1 - p1) * up + p1 * stay))
         FROM f JOIN e ON e.symbol = f.symbol AND e.fold = f.fold AND e.rn = f.rn + 1)
       SELECT x.symbol, x.fold, x.bar_close, round(coalesce(p1, 0.5), 6) AS p_high_vol FROM x LEFT JOIN (SELECT symbol, fold, bar_close, p1 FROM e JOIN f USING (symbol, fold, rn)) g
         ON x.symbol = g.symbol AND x.fold = g.fold AND x.bar_close = g.bar_close""",
    "folded rv60",
)
def vol_state_filter(t: Tables):
    """The same filter with the chain's starting parameters (states split at the mean volatility, moves counted)."""
    out = G.volatility_posterior(volatility_rows(t), fold="fold", key=DAILY, train=C("role") == "train", ret="ret", rv="rv", out="p_high_vol", turns=0)
    return out.select("symbol", "fold", "bar_close", rnd(C("p_high_vol")).alias("p_high_vol"))


view(
    "datr",
    f"""WITH l AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS c1 FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY bar_close)),
        tr AS (SELECT symbol, bar_close, rn, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr FROM l),
        e AS ({ewm_sql('tr', 'tr', '(1 / 14.0::DOUBLE)', 'y')})
        SELECT symbol, bar_close, CASE WHEN rn >= 14 THEN y END AS atr FROM e""",
    "daily",
)


@query(
    "fold_sidecar",
    f"""WITH n AS (SELECT b.symbol, b.bar_close, high, low, close, atr, ln(lead(close) OVER (PARTITION BY b.symbol ORDER BY b.bar_close)) - ln(close) AS nr
                   FROM daily b JOIN datr USING (symbol, bar_close)),
        lab AS (SELECT symbol, bar_close, ({_TB})::BIGINT AS label FROM n),
        f AS (SELECT d.symbol, d.bar_close, d.fold, d.role, r.rv, lab.label FROM folded d JOIN rv60 r USING (symbol, bar_close)
              JOIN lab USING (symbol, bar_close) WHERE role IS NOT NULL),
        q AS (SELECT symbol, fold, quantile_cont(rv, 1 / 3.0::DOUBLE) AS t1, quantile_cont(rv, 2 / 3.0::DOUBLE) AS t2 FROM f WHERE role = 'train' AND rv IS NOT NULL GROUP BY 1, 2)
        SELECT f.symbol, f.fold, f.bar_close, role, label, coalesce(rv <= t1, false)::BIGINT AS rv_low, coalesce(rv > t1 AND rv <= t2, false)::BIGINT AS rv_mid,
               coalesce(rv > t2, false)::BIGINT AS rv_high FROM f LEFT JOIN q USING (symbol, fold)""",
    "folded rv60 datr",
)
def fold_sidecar(t: Tables):
    """Labels and regime flags per fold, thresholds fitted on its train rows;
    all folds in one job."""
    a = 1 / 14

    def compute(d, w):
        d = d.withColumn("__r", R.log_return(C("close"), 1, w))
        d = d.withColumn("rv", R.std(C("__r"), 60, 60, w))
        d = d.withColumn("__tr", R.true_range(C("high"), C("low"), F.lag("close").over(w)))
        d = with_ewm(d, w, {"__atr": Ewm(C("__tr"), a)})
        atr = F.when(C(POS) >= 14, C("__atr"))
        d = d.withColumn("barrier", L.atr_barrier(atr, C("close")))
        nxt = safe_ln(F.lead("close").over(w)) - safe_ln(C("close"))
        return d.withColumn("next_return", nxt)

    bars = over_rows(
        t.daily.select("symbol", "bar_close", "high", "low", "close"), DAILY, compute,
        lookback=60, lookahead=1, block_rows=ewm_block(a, 61),
    )
    spread = clip(proxy_spread(), 0, 200)
    bars = bars.withColumn("label", L.triple_barrier_label(C("next_return"), C("barrier"), C("barrier"), spread))
    rows = materialise(folded(t, bars.select("symbol", "bar_close", "rv", "label")))
    cuts = G.fit_terciles(rows.filter(C("role") == "train"), ["symbol", "fold"], "rv")
    low, mid, high = G.tercile_flags(C("rv"), C("rv_t1"), C("rv_t2"))
    return rows.join(cuts, ["symbol", "fold"], "left").select(
        "symbol", "fold", "bar_close", "role", "label", low.alias("rv_low"), mid.alias("rv_mid"), high.alias("rv_high")
    )
