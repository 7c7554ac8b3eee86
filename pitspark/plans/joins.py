"""As-of, interval and calendar joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitspark.functions.mathfn import clip, rnd
from pitspark.functions.timefn import seconds_between, shift_seconds
from pitspark.operators import intervals
from pitspark.operators.asof import asof_join, event_within, nearest_events
from pitspark.operators.chunked import SeriesKey
from pitspark.operators.versions import latest_by
from pitspark.plans.registry import query
from pitspark.sources.views import DAY, Tables


@query(
    "asof_strict",
    """SELECT b.symbol, b.bar_close, round(b.close, 6) AS close, a.article_id, a.t_visible AS article_visible
       FROM bars b ASOF LEFT JOIN (
         SELECT t_visible, max(article_id) AS article_id FROM articles GROUP BY 1) a
       ON b.bar_close > a.t_visible""",
    "bars articles",
)
def asof_strict(t: Tables):
    """Latest article visible strictly before each bar close."""
    out = asof_join(
        t.bars.select("symbol", "bar_close", "close"),
        t.article_times,
        left_time="bar_close",
        right_time="t_visible",
        strict=True,
        columns=["article_id"],
        tie=["article_id"],
        matched_time="article_visible",
    )
    return out.withColumn("close", rnd(F.col("close")))


@query(
    "asof_inclusive",
    """WITH grid AS (SELECT DISTINCT symbol, bar_close AS day FROM daily),
            v AS (SELECT series_id, t_visible, arg_max(value, date) AS value, max(date) AS date FROM
                  (SELECT series_id, realtime_start AS t_visible, value, date FROM vintages) GROUP BY 1, 2)
       SELECT g.symbol, g.day, v.value, v.date AS obs_date
       FROM grid g ASOF LEFT JOIN v ON g.symbol = v.series_id AND g.day >= v.t_visible""",
    "daily vintages",
)
def asof_inclusive(t: Tables):
    """Latest revision visible on or before each day, per series."""
    grid = t.daily.select("symbol", F.col("bar_close").alias("day"))
    out = asof_join(
        grid,
        t.vintages.withColumnRenamed("series_id", "symbol"),
        left_time="day",
        right_time="t_visible",
        strict=False,
        columns=["value", "date"],
        by=["symbol"],
        tie=["date"],
        bucket_seconds=180 * DAY,
    )
    return out.withColumnRenamed("date", "obs_date")


@query(
    "asof_tolerance",
    """SELECT s.event_id, s.symbol, s.ts,
              CASE WHEN s.ts - b.bar_close <= INTERVAL 30 MINUTE THEN round(b.close, 6) END AS close
       FROM ticks s ASOF LEFT JOIN bars b ON s.symbol = b.symbol AND s.ts >= b.bar_close""",
    "bars",
)
def asof_tolerance(t: Tables):
    """Last bar close at or before each tick, at most 30 minutes old."""
    return asof_join(
        t.ticks.select("event_id", "symbol", "ts"),
        t.bars.select("symbol", "bar_close", rnd(F.col("close")).alias("close")),
        left_time="ts",
        right_time="bar_close",
        strict=False,
        columns=["close"],
        by=["symbol"],
        tolerance_seconds=1800,
    )


@query(
    "asof_forward",
    """SELECT a.article_id, a.t_visible, b.bar_close AS next_close
       FROM articles a ASOF LEFT JOIN (SELECT DISTINCT bar_close FROM bars) b ON a.t_visible <= b.bar_close""",
    "bars articles",
)
def asof_forward(t: Tables):
    """First bar close on or after an article becomes visible."""
    return asof_join(
        t.article_times.select("article_id", "t_visible"),
        t.bars.select("bar_close").distinct(),
        left_time="t_visible",
        right_time="bar_close",
        strict=False,
        direction="forward",
        columns=[],
        matched_time="next_close",
    )


PANEL_SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "asof_multi_series",
    """WITH grid AS (SELECT unnest(generate_series((SELECT min(date) FROM vintages), (SELECT max(date) FROM vintages), INTERVAL 1 DAY)) AS day),
       sid AS (SELECT DISTINCT series_id FROM vintages),
       first AS (SELECT series_id, date, min(realtime_start) AS t_visible, arg_min(value, realtime_start) AS value
                 FROM vintages GROUP BY 1, 2),
       v AS (SELECT series_id, t_visible, arg_max(value, date) AS value FROM first GROUP BY 1, 2),
       j AS (SELECT g.day, g.series_id, v.value, v.t_visible FROM (SELECT day, series_id FROM grid, sid) g
             ASOF LEFT JOIN v ON g.series_id = v.series_id AND g.day >= v.t_visible)
       SELECT day, max(t_visible) AS t_visible_max,
              max(CASE WHEN series_id = '1-URGENT' THEN value END) AS urgent,
              max(CASE WHEN series_id = '2-HIGH' THEN value END) AS high,
              max(CASE WHEN series_id = '3-MEDIUM' THEN value END) AS medium,
              max(CASE WHEN series_id = '4-NOT SPECIFIED' THEN value END) AS unspecified,
              max(CASE WHEN series_id = '5-LOW' THEN value END) AS low
       FROM j GROUP BY day""",
    "vintages",
)
def asof_multi_series(t: Tables):
    """Daily panel: each series carried forward on its own visibility."""
    from pitspark.operators.panel import asof_panel, daily_grid

    v = latest_by(
        t.vintages, ["series_id", "date"], order=["realtime_start"], pick=["value", "t_visible"], first=True
    )
    days = daily_grid(t.vintages, "date", "day")
    out = asof_panel(
        days,
        v,
        day="day",
        series="series_id",
        value="value",
        visible="t_visible",
        tie=["date"],
        names=dict(zip(PANEL_SERIES, ("urgent", "high", "medium", "unspecified", "low"))),
    )
    return out.withColumnRenamed("t_visible", "t_visible_max")


@query(
    "spread_inner_join",
    """WITH l AS (SELECT series_id, date, max(realtime_start) AS t_visible, arg_max(value, realtime_start) AS value
                 FROM vintages GROUP BY 1, 2)
       SELECT a.date, greatest(a.t_visible, b.t_visible, c.t_visible) AS t_visible,
              round(a.value - b.value, 6) AS spread,
              round(2 * b.value - a.value - c.value, 6) AS butterfly
       FROM l a JOIN l b ON a.date = b.date AND b.series_id = '2-HIGH'
                JOIN l c ON a.date = c.date AND c.series_id = '5-LOW'
       WHERE a.series_id = '1-URGENT'""",
    "vintages",
)
def spread_inner_join(t: Tables):
    """Spread and butterfly of three series, visible when the last leg is."""
    latest = latest_by(t.vintages, ["series_id", "date"], order=["realtime_start"], pick=["value", "t_visible"])
    return intervals.legs_on_date(
        latest,
        legs={"a": "1-URGENT", "b": "2-HIGH", "c": "5-LOW"},
        series="series_id",
        formulas={
            "spread": lambda v: rnd(v["a"] - v["b"], 6),
            "butterfly": lambda v: rnd(F.lit(2) * v["b"] - v["a"] - v["c"], 6),
        },
    )


@query(
    "outer_calendars",
    """WITH a AS (SELECT bar_open AS date, close, t_visible FROM (SELECT *, bar_close AS t_visible FROM daily) WHERE symbol = '1-URGENT'),
            b AS (SELECT bar_open AS date, close, t_visible FROM (SELECT *, bar_close + INTERVAL 2 HOUR AS t_visible FROM daily) WHERE symbol = '5-LOW')
       SELECT coalesce(a.date, b.date) AS date, a.close AS close_a, b.close AS close_b,
              greatest(a.t_visible, b.t_visible) AS t_visible, round(a.close - b.close, 4) AS spread
       FROM a FULL JOIN b ON a.date = b.date""",
    "daily",
)
def outer_calendars(t: Tables):
    """Two daily calendars on one date axis."""
    d = t.daily.select(F.col("bar_open").alias("date"), "symbol", "close", "t_visible")
    a = d.filter(F.col("symbol") == "1-URGENT").select(
        "date", F.col("close").alias("close_a"), F.col("t_visible").alias("va")
    )
    b = d.filter(F.col("symbol") == "5-LOW").select(
        "date", F.col("close").alias("close_b"), shift_seconds(F.col("t_visible"), 7200).alias("vb")
    )
    return a.join(b, "date", "outer").select(
        "date",
        "close_a",
        "close_b",
        F.greatest("va", "vb").alias("t_visible"),
        rnd(F.col("close_a") - F.col("close_b"), 4).alias("spread"),
    )


@query(
    "shifted_left_join",
    """WITH agg AS (SELECT date_trunc('hour', t_visible) + INTERVAL 1 HOUR AS bar_close, count(*) AS n,
                           count(*) FILTER (WHERE lang = 'en') AS n_en FROM articles GROUP BY 1)
       SELECT b.symbol, b.bar_close, coalesce(a.n, 0) AS article_count, coalesce(a.n_en, 0) AS en_count
       FROM bars b LEFT JOIN agg a ON b.bar_close = a.bar_close + INTERVAL 1 HOUR""",
    "bars articles",
)
def shifted_left_join(t: Tables):
    """Per-bar article aggregates attached one bar later."""
    agg = intervals.per_bar(
        t.article_times,
        time="t_visible",
        seconds=3600,
        aggs=[F.count(F.lit(1)).alias("article_count"), F.count_if(F.col("lang") == "en").alias("en_count")],
    )
    return intervals.attach_shifted(
        t.bars.select("symbol", "bar_close"), agg, on="bar_close", seconds=3600, fill=["article_count", "en_count"]
    )


@query(
    "articles_per_bar",
    """WITH w AS (SELECT symbol, bar_close,
                   coalesce(lag(bar_close) OVER (PARTITION BY symbol ORDER BY bar_close), bar_close - INTERVAL 60 MINUTE) AS prev
                 FROM bars)
       SELECT w.symbol, w.bar_close, count(a.article_id) AS news_count
       FROM w LEFT JOIN articles a ON a.t_visible > w.prev AND a.t_visible <= w.bar_close
       GROUP BY 1, 2""",
    "bars articles",
)
def articles_per_bar(t: Tables):
    """Articles becoming visible in (previous close, close]."""
    return intervals.count_between(
        t.bars.select("symbol", "bar_close"),
        t.article_times.select("article_id", "t_visible"),
        key=SeriesKey(("symbol",), "bar_close", (), 7 * DAY),
        event_time="t_visible",
        event_tie=("article_id",),
        first_seconds=3600,
        out="news_count",
    )


@query(
    "event_within_60m",
    """WITH ev AS (SELECT DISTINCT ts FROM events WHERE event_type = 'error' AND value > 440)
       SELECT b.symbol, b.bar_close, EXISTS (SELECT 1 FROM ev WHERE ev.ts >= b.bar_close - INTERVAL 60 MINUTE
              AND ev.ts <= b.bar_close + INTERVAL 60 MINUTE) AS event_within_60min FROM bars b""",
    "bars",
)
def event_within_60m(t: Tables):
    """Any large error event within an hour of the bar close."""
    ev = t.ticks.filter((F.col("symbol") == "error") & (F.col("price") > 440)).select("ts")
    out = nearest_events(
        t.bars.select("symbol", "bar_close"), ev, left_time="bar_close", event_time="ts", bucket_seconds=DAY
    )
    flag = event_within(F.col("prev_event"), F.col("next_event"), F.col("bar_close"), 3600)
    return out.select("symbol", "bar_close", flag.alias("event_within_60min"))


@query(
    "event_within_24h",
    """WITH g AS (SELECT DISTINCT bar_open AS day FROM daily),
       pairs AS (SELECT g.day, s.event_type, s.tier FROM g JOIN schedule s
                 ON s.event_ts >= g.day - INTERVAL 24 HOUR AND s.event_ts <= g.day + INTERVAL 24 HOUR)
       SELECT g.day, coalesce(bool_or(p.event_type = 'CPI'), false) AS cpi, coalesce(bool_or(p.event_type = 'NFP'), false) AS nfp,
              coalesce(bool_or(p.event_type = 'GDP'), false) AS gdp, coalesce(bool_or(p.event_type = 'JOLTS'), false) AS jolts,
              coalesce(bool_or(p.event_type = 'PCE'), false) AS pce, coalesce(bool_or(p.event_type = 'FOMC'), false) AS fomc,
              coalesce(bool_or(p.event_type = 'FOMC_minutes'), false) AS fomc_minutes,
              coalesce(bool_or(p.tier = 1), false) AS any_tier1
       FROM g LEFT JOIN pairs p USING (day) GROUP BY 1""",
    "daily schedule",
)
def event_within_24h(t: Tables):
    """Per event type: any scheduled event within a day of the grid day."""
    days = t.daily.select(F.col("bar_open").alias("day")).distinct()
    flags = {
        "cpi": F.col("event_type") == "CPI",
        "nfp": F.col("event_type") == "NFP",
        "gdp": F.col("event_type") == "GDP",
        "jolts": F.col("event_type") == "JOLTS",
        "pce": F.col("event_type") == "PCE",
        "fomc": F.col("event_type") == "FOMC",
        "fomc_minutes": F.col("event_type") == "FOMC_minutes",
        "any_tier1": F.col("tier") == 1,
    }
    schedule = t.schedule
    return intervals.flags_within(days, schedule, at="day", event_time="event_ts", seconds=DAY, flags=flags)


@query(
    "days_since_event",
    """WITH ev AS (SELECT event_ts FROM schedule WHERE event_type = 'NFP'),
       b AS (SELECT symbol, bar_close, lag(bar_open) OVER (PARTITION BY symbol ORDER BY bar_close) AS lag_ts FROM daily)
       SELECT b.symbol, b.bar_close,
              CASE WHEN e.event_ts IS NOT NULL
                   THEN round(least(epoch(b.lag_ts - e.event_ts) / 86400.0, 100.0) / 100.0, 6) END AS days_since
       FROM b ASOF LEFT JOIN ev e ON b.lag_ts >= e.event_ts""",
    "daily schedule",
)
def days_since_event(t: Tables):
    """Days since the last payroll release at the lagged bar time, capped."""
    bars = intervals.lag_time(t.daily.select("symbol", "bar_open", "bar_close"), DAILY_KEY, "bar_open", "lag_ts")
    ev = t.schedule.filter(F.col("event_type") == "NFP").select("event_ts")
    out = nearest_events(bars, ev, left_time="lag_ts", event_time="event_ts", bucket_seconds=180 * DAY)
    days = seconds_between(F.col("lag_ts"), F.col("prev_event")) / 86_400.0
    return out.select("symbol", "bar_close", rnd(clip(days, hi=100.0) / 100.0).alias("days_since"))


DAILY_KEY = SeriesKey(("symbol",), "bar_close", (), 365 * DAY)


@query(
    "event_week",
    """WITH ev AS (SELECT event_ts FROM schedule WHERE event_type = 'NFP'),
       b AS (SELECT symbol, bar_close, lag(bar_open) OVER (PARTITION BY symbol ORDER BY bar_close) AS lag_ts FROM daily)
       SELECT b.symbol, b.bar_close, CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.event_ts
              BETWEEN b.lag_ts - INTERVAL 3 DAY AND b.lag_ts + INTERVAL 3 DAY) THEN 1.0 ELSE 0.0 END::DOUBLE AS is_event_week
       FROM b""",
    "daily schedule",
)
def event_week(t: Tables):
    """Lagged bar time within three days of an event."""
    bars = intervals.lag_time(t.daily.select("symbol", "bar_open", "bar_close"), DAILY_KEY, "bar_open", "lag_ts")
    ev = t.schedule.filter(F.col("event_type") == "NFP").select("event_ts")
    out = nearest_events(bars, ev, left_time="lag_ts", event_time="event_ts", bucket_seconds=180 * DAY)
    flag = event_within(F.col("prev_event"), F.col("next_event"), F.col("lag_ts"), 3 * DAY)
    return out.select("symbol", "bar_close", flag.cast("double").alias("is_event_week"))


@query(
    "bar_article_slots",
    """WITH l AS (SELECT b.symbol, b.bar_close, a.article_id, row_number() OVER (PARTITION BY b.symbol, b.bar_close
                  ORDER BY a.t_visible, a.article_id) AS slot FROM bars b JOIN articles a
                  ON a.t_visible < b.bar_close AND a.t_visible >= b.bar_close - INTERVAL 4 HOUR)
       SELECT b.symbol, b.bar_close, count(l.article_id) AS n_slots,
              coalesce(string_agg(l.article_id::VARCHAR, '|' ORDER BY l.slot), '') AS slots,
              count(l.article_id) > 0 AS is_present
       FROM bars b LEFT JOIN l ON l.symbol = b.symbol AND l.bar_close = b.bar_close AND l.slot <= 8 GROUP BY 1, 2""",
    "bars articles",
)
def bar_article_slots(t: Tables):
    """First eight articles visible in the four hours before each bar close."""
    return intervals.lookback_slots(
        t.bars.select("symbol", "bar_close"),
        t.article_times.select("article_id", "t_visible"),
        by=("symbol",),
        at="bar_close",
        event_time="t_visible",
        event_id="article_id",
        seconds=4 * 3600,
        slots=8,
    ).select(
        "symbol",
        "bar_close",
        F.size("slots").cast("long").alias("n_slots"),
        F.array_join("slots", "|").alias("slots"),
        (F.size("slots") > 0).alias("is_present"),
    )


@query(
    "row_alignment",
    """WITH a AS (SELECT symbol, bar_close FROM bars), b AS (SELECT symbol, bar_close FROM bars WHERE volume > 1)
       SELECT 'left_only' AS side, count(*) AS n FROM a ANTI JOIN b USING (symbol, bar_close)
       UNION ALL SELECT 'right_only', count(*) FROM b ANTI JOIN a USING (symbol, bar_close)
       UNION ALL SELECT 'both', count(*) FROM a SEMI JOIN b USING (symbol, bar_close)""",
    "bars",
)
def row_alignment(t: Tables):
    """Keys of a table and of its sidecar that do not line up."""
    from pitspark.operators.quality import key_alignment

    base = t.bars.select("symbol", "bar_close")
    side = t.bars.filter(F.col("volume") > 1).select("symbol", "bar_close")
    return key_alignment(base, side, ["symbol", "bar_close"])


