"""Aggregations and version choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitspark.functions import text as X
from pitspark.functions.mathfn import rnd
from pitspark.operators import rolling as R
from pitspark.operators.chunked import over_rows
from pitspark.operators.intervals import per_bar
from pitspark.operators.labels import calendar_split, fixed_label
from pitspark.operators.ranks import exact_quantiles
from pitspark.operators.versions import as_known_at, latest_by
from pitspark.operators.vintages import as_known_at_rows
from pitspark.plans.registry import query, view
from pitspark.plans.scalars import feature_names
from pitspark.plans.sources import TEST_THEMES
from pitspark.sources.views import BAR, DAILY, Tables

C = F.col


@query(
    "latest_revision",
    "SELECT series_id, date, max(realtime_start) AS realtime_start, arg_max(value, realtime_start) AS value FROM vintages GROUP BY 1, 2",
    "vintages",
)
def latest_revision(t: Tables):
    """Last revision per observation date."""
    return latest_by(t.vintages, ["series_id", "date"], order=["realtime_start"], pick=["realtime_start", "value"])


@query(
    "first_release",
    "SELECT series_id, date, min(realtime_start) AS realtime_start, arg_min(value, realtime_start) AS value FROM vintages GROUP BY 1, 2",
    "vintages",
)
def first_release(t: Tables):
    """First release per observation date."""
    return latest_by(
        t.vintages, ["series_id", "date"], order=["realtime_start"], pick=["realtime_start", "value"], first=True
    )


@query(
    "vintage_as_of",
    """SELECT series_id, date, max(realtime_start) AS realtime_start, arg_max(value, realtime_start) AS value FROM vintages
       WHERE realtime_start <= TIMESTAMP '1998-06-30' GROUP BY 1, 2""",
    "vintages",
)
def vintage_as_of(t: Tables):
    """Each series as it was known at an instant."""
    known = as_known_at(t.vintages, ["series_id", "date"], at="1998-06-30")
    return known.select("series_id", "date", "realtime_start", "value")


@query(
    "vintages_at_bars",
    """WITH m AS (SELECT b.symbol, b.bar_close, max(v.date) AS obs FROM daily b LEFT JOIN vintages v ON v.series_id = b.symbol AND v.realtime_start <= b.bar_close GROUP BY 1, 2),
       p AS (SELECT series_id, date, lag(date) OVER (PARTITION BY series_id ORDER BY date) AS prev FROM (SELECT DISTINCT series_id, date FROM vintages)),
       d AS (SELECT m.*, p.prev FROM m LEFT JOIN p ON p.series_id = m.symbol AND p.date = m.obs)
       SELECT d.symbol, d.bar_close, any_value(d.obs) AS obs_0, round(arg_max(a.value, a.realtime_start), 6) AS value_0, any_value(d.prev) AS obs_1, round(any_value(b.value), 6) AS value_1
       FROM d LEFT JOIN vintages a ON a.series_id = d.symbol AND a.date = d.obs AND a.realtime_start <= d.bar_close
       LEFT JOIN (SELECT d.symbol, d.bar_close, arg_max(v.value, v.realtime_start) AS value FROM d JOIN vintages v ON v.series_id = d.symbol AND v.date = d.prev AND v.realtime_start <= d.bar_close GROUP BY 1, 2) b
         ON b.symbol = d.symbol AND b.bar_close = d.bar_close GROUP BY 1, 2""",
    "daily vintages",
)
def vintages_at_bars(t: Tables):
    """At every daily bar, the latest observation of its series and the one before it, both as known then."""
    series = t.vintages.select(C("series_id").alias("symbol"), "date", "realtime_start", "value")
    out = as_known_at_rows(t.daily.select("symbol", "bar_close"), series, left_time="bar_close", by=["symbol"], lags=(0, 1))
    return out.select("symbol", "bar_close", "obs_0", rnd(C("value_0")).alias("value_0"), "obs_1", rnd(C("value_1")).alias("value_1"))


@query(
    "latest_snapshot",
    """SELECT l_partkey, l_linenumber, max(l_shipdate) AS fetch_ts, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_suppkey, l_extendedprice)) AS value
       FROM lineitem GROUP BY 1, 2""",
)
def latest_snapshot(t: Tables):
    """Latest fetch per key."""
    src = t.read("lineitem").select(
        "l_partkey", "l_linenumber", C("l_shipdate").alias("fetch_ts"), "l_orderkey", "l_suppkey", C("l_extendedprice").alias("value")
    )
    return latest_by(
        src, ["l_partkey", "l_linenumber"], order=["fetch_ts", "l_orderkey", "l_suppkey", "value"], pick=["fetch_ts", "value"]
    )


@query(
    "sum_max_group",
    """SELECT report_date, sum(total) AS world_total, max(report_date + to_days((contract % 40)::INT)) AS t_visible FROM positions_book
       WHERE contract <> 7 GROUP BY 1""",
    "positions_book",
)
def sum_max_group(t: Tables):
    """World total per period without the aggregate row, visible with its last part."""
    vis = C("report_date") + F.make_dt_interval((C("contract") % 40).cast("int"))
    parts = t.positions_book.filter(C("contract") != 7)
    return parts.groupBy("report_date").agg(F.sum("total").alias("world_total"), F.max(vis).alias("t_visible"))


_TONE = "(length(body) % 100) / 10.0"


@query(
    "theme_per_bar",
    f"""WITH a AS (SELECT date_trunc('hour', t_visible) + INTERVAL 1 HOUR AS bar_close, body, {_TONE} AS tone FROM articles)
        SELECT bar_close, count(*) AS article_count, {', '.join(f"count(*) FILTER (WHERE regexp_matches(body, '{p}')) AS {n}_mentions" for n, p in TEST_THEMES.items())},
        round(avg(tone), 6) AS tone_mean, round(stddev_samp(tone), 6) AS tone_std FROM a GROUP BY 1""",
    "articles",
)
def theme_per_bar(t: Tables):
    """Article, theme and tone aggregates per bar."""
    flags = X.pattern_flags(C("body"), TEST_THEMES)
    a = t.articles.withColumn("tone", F.length("body") % 100 / 10.0)
    return per_bar(
        a,
        time="t_visible",
        seconds=3600,
        aggs=[
            F.count(F.lit(1)).alias("article_count"),
            *[F.count_if(c).alias(f"{n}_mentions") for n, c in flags.items()],
            rnd(F.avg("tone")).alias("tone_mean"),
            rnd(F.stddev_samp("tone")).alias("tone_std"),
        ],
    )


view(
    "labelled",
    """SELECT symbol, bar_close, close, nr, CASE WHEN nr > 0.0005 THEN 2 WHEN nr < -0.0005 THEN 0 WHEN nr IS NOT NULL THEN 1 END AS label FROM
       (SELECT symbol, bar_close, close, ln(lead(close) OVER (PARTITION BY symbol ORDER BY bar_close) / close) AS nr FROM bars)""",
    "bars",
)


def labelled(t: Tables):
    """Bars with next log return and fixed-threshold label."""

    def compute(d, w):
        nxt = F.ln(F.lead("close").over(w) / C("close"))
        return d.withColumn("next_return", nxt).withColumn("label", fixed_label(C("next_return")))

    return over_rows(t.bars.select("symbol", "bar_close", "close"), BAR, compute, lookback=0, lookahead=1)


@query(
    "class_distribution",
    """SELECT symbol, round(avg((label = 0)::INT), 6) AS down, round(avg((label = 1)::INT), 6) AS flat, round(avg((label = 2)::INT), 6) AS up
       FROM labelled WHERE label IS NOT NULL GROUP BY 1""",
    "labelled",
)
def class_distribution(t: Tables):
    """Share of each class among labelled bars."""
    shares = [
        rnd(F.coalesce(F.avg(F.when(C("label").isNotNull(), (C("label") == k).cast("double"))), F.lit(0.0))).alias(n)
        for k, n in enumerate(("down", "flat", "up"))
    ]
    return labelled(t).groupBy("symbol").agg(*shares)


@query(
    "class_weights",
    """SELECT symbol, k AS label, round(count(*) / (3.0 * greatest(count(*) FILTER (WHERE label = k), 1)), 6) AS weight
       FROM labelled, (VALUES (0::BIGINT), (1), (2)) v(k) WHERE label IS NOT NULL GROUP BY 1, 2""",
    "labelled",
)
def class_weights(t: Tables):
    """Inverse-frequency class weights."""
    counts = labelled(t).groupBy("symbol").agg(
        F.count("label").alias("n"), *[F.count_if(C("label") == k).alias(str(k)) for k in range(3)]
    )
    long = counts.unpivot(["symbol", "n"], ["0", "1", "2"], "label", "c")
    weight = C("n") / (F.lit(3.0) * F.greatest(C("c"), F.lit(1)))
    return long.select("symbol", C("label").cast("long").alias("label"), rnd(weight).alias("weight"))


view(
    "rv60",
    """SELECT symbol, bar_close, close, volume, CASE WHEN count(r) OVER w >= 60 THEN stddev_samp(r) OVER w END AS rv FROM
       (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY bar_close)) AS r FROM daily)
       WINDOW w AS (PARTITION BY symbol ORDER BY bar_close ROWS 59 PRECEDING)""",
    "daily",
)


def with_rv60(d, w):
    d = d.withColumn("__r", R.log_return(C("close"), 1, w))
    return d.withColumn("rv", R.std(C("__r"), 60, 60, w)).drop("__r")


def rv60(t: Tables):
    return over_rows(t.daily.select("symbol", "bar_close", "close", "volume"), DAILY, with_rv60, lookback=60)


@query(
    "tercile_thresholds",
    """SELECT symbol, round(quantile_cont(rv, 1 / 3.0::DOUBLE), 6) AS rv_t1, round(quantile_cont(rv, 2 / 3.0::DOUBLE), 6) AS rv_t2, count(rv) AS n_values
       FROM rv60 WHERE bar_close < TIMESTAMP '1999-01-01' AND rv IS NOT NULL GROUP BY 1""",
    "rv60",
)
def tercile_thresholds(t: Tables):
    """Exact tercile cuts of realised volatility on training rows."""
    train = rv60(t).filter(C("bar_close") < F.lit("1999-01-01").cast("timestamp_ntz"))
    q = exact_quantiles(train, ["symbol"], "rv", {"rv_t1": 1 / 3, "rv_t2": 2 / 3})
    return q.select("symbol", rnd(C("rv_t1")).alias("rv_t1"), rnd(C("rv_t2")).alias("rv_t2"), "n_values")


@query(
    "split_counts",
    """SELECT symbol, CASE WHEN bar_close > TIMESTAMP '2000-06-30' THEN 'test' WHEN bar_close > TIMESTAMP '1999-06-30' THEN 'val' ELSE 'train' END AS split,
              count(*) AS n FROM daily GROUP BY 1, 2""",
    "daily",
)
def split_counts(t: Tables):
    """Rows per calendar split."""
    split = calendar_split(C("bar_close"), "1999-06-30", "2000-06-30")
    return t.daily.groupBy("symbol", split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "importance_rollup",
    """SELECT category, count(*) AS n_features, round(avg(abs(importance)), 6) AS mean_abs, round(sum(abs(importance)), 6) AS sum_abs,
              arg_max(name, (abs(importance), name)) AS top_feature FROM feature_cats GROUP BY 1""",
    "feature_cats",
)
def importance_rollup(t: Tables):
    """Importance per feature category."""
    from pitspark.operators.importance import rollup

    out = rollup(feature_names(t), name="name", value="importance")
    return out.select(
        "category", "n_features", rnd(C("mean_abs")).alias("mean_abs"), rnd(C("sum_abs")).alias("sum_abs"), "top_feature"
    )


@query(
    "feature_moments",
    """WITH l AS (SELECT l_quantity AS qty, l_discount AS disc, l_tax AS tax, l_returnflag = 'R' AS present FROM lineitem),
       u AS (SELECT 'qty' AS feature, qty AS v, present FROM l UNION ALL SELECT 'disc', disc, present FROM l UNION ALL SELECT 'tax', tax, present FROM l)
       SELECT feature, round(avg(v), 6) AS mean, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)), 6) AS std,
              round(avg(v) FILTER (WHERE present), 6) AS mean_present, round(avg(v) FILTER (WHERE NOT present), 6) AS mean_absent FROM u GROUP BY 1""",
)
def feature_moments(t: Tables):
    """Mean and deviation per feature, overall and per bucket."""
    from pitspark.operators.importance import moments

    li = t.read("lineitem").select(
        C("l_quantity").alias("qty"), C("l_discount").alias("disc"), C("l_tax").alias("tax"), (C("l_returnflag") == "R").alias("present")
    )
    out = moments(li, ["qty", "disc", "tax"], present=C("present"))
    return out.select("feature", *[rnd(C(c)).alias(c) for c in ("mean", "std", "mean_present", "mean_absent")])


@query(
    "top_features",
    """SELECT name, category, round(importance, 6) AS importance FROM
       (SELECT *, row_number() OVER (PARTITION BY category ORDER BY abs(importance) DESC, name) AS rn FROM feature_cats) WHERE rn <= 5""",
    "feature_cats",
)
def top_features(t: Tables):
    """Five most important features per category."""
    from pitspark.operators.importance import top_per_category

    out = top_per_category(feature_names(t), name="name", value="importance", n=5)
    return out.select("name", "category", rnd(C("importance")).alias("importance"))
