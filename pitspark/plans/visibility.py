"""Visibility rules, schedules and session features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitspark.functions import sessions as S
from pitspark.functions import visibility as V
from pitspark.functions.mathfn import rnd
from pitspark.functions.text import published_fallback
from pitspark.functions.timefn import shift_seconds
from pitspark.operators.chunked import over_rows
from pitspark.operators.panel import daily_grid as day_grid
from pitspark.plans.registry import query
from pitspark.sources.views import BAR, Tables

C = F.col

NY = "AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'"
ET = "AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'"

# Release minutes of the test series.
TEST_RELEASE = {"1-URGENT": 975, "2-HIGH": 510, "3-MEDIUM": 990, "4-NOT SPECIFIED": 540, "5-LOW": 780}
TEST_SETTLEMENT = {"1-URGENT": 870, "2-HIGH": 900}


@query("vis_bar_end", "SELECT symbol, bar_open, bar_open + INTERVAL 60 MINUTE AS t_visible FROM bars", "bars")
def vis_bar_end(t: Tables):
    """A bar is public at its end."""
    return t.bars.select("symbol", "bar_open", V.bar_end(C("bar_open"), 60).alias("t_visible"))


@query("vis_news", "SELECT article_id, created_at + INTERVAL 60 SECOND AS t_visible FROM articles", "articles")
def vis_news(t: Tables):
    """News is public a minute after creation."""
    return t.article_times.select("article_id", V.after_latency(C("created_at")).alias("t_visible"))


@query(
    "vis_max_of",
    """SELECT event_id, greatest(ts + INTERVAL 30 MINUTE, date_trunc('hour', ts) + INTERVAL 1 HOUR) AS t_visible FROM events""",
)
def vis_max_of(t: Tables):
    """Later of publication plus buffer and partition time."""
    part = shift_seconds(F.date_trunc("hour", "ts").cast("timestamp_ntz"), 3600)
    return t.read("events").select("event_id", V.publish_or_partition(C("ts"), part).alias("t_visible"))


@query(
    "vis_release_tod",
    f"""SELECT series_id, date, realtime_start, ((realtime_start + to_minutes(CASE series_id WHEN '1-URGENT' THEN 975 WHEN '2-HIGH' THEN 510
        WHEN '3-MEDIUM' THEN 990 WHEN '4-NOT SPECIFIED' THEN 540 ELSE 780 END)) {NY} AS release_ts FROM vintages""",
    "vintages",
)
def vis_release_tod(t: Tables):
    """Local release time of day per series, daylight saving aware."""
    ts = V.release_time_of_day(C("realtime_start"), C("series_id"), TEST_RELEASE)
    return t.vintages.select("series_id", "date", "realtime_start", ts.alias("release_ts"))


_GOOD_FRIDAYS = "'1995-04-14','1996-04-05','1997-03-28','1998-04-10','1999-04-02','2000-04-21','2001-04-13','2002-03-29','2003-04-18','2004-04-09'"


@query(
    "vis_next_session",
    f"""WITH d AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2004-12-31', INTERVAL 1 DAY))::DATE AS d),
       h AS (SELECT d FROM d WHERE strftime(d, '%Y-%m-%d') IN ({_GOOD_FRIDAYS}, '2001-09-11','2001-09-12','2001-09-13','2001-09-14','2004-06-11')
         OR (month(d) = 1 AND ((day(d) = 1) OR (day(d) = 2 AND dayofweek(d) = 1)))
         OR (year(d) >= 1998 AND month(d) = 1 AND dayofweek(d) = 1 AND day(d) BETWEEN 15 AND 21)
         OR (month(d) = 2 AND dayofweek(d) = 1 AND day(d) BETWEEN 15 AND 21)
         OR (month(d) = 5 AND dayofweek(d) = 1 AND day(d) >= 25)
         OR (month(d) = 7 AND ((day(d) = 4) OR (day(d) = 5 AND dayofweek(d) = 1) OR (day(d) = 3 AND dayofweek(d) = 5)))
         OR (month(d) = 9 AND dayofweek(d) = 1 AND day(d) <= 7)
         OR (month(d) = 11 AND dayofweek(d) = 4 AND day(d) BETWEEN 22 AND 28)
         OR (month(d) = 12 AND ((day(d) = 25) OR (day(d) = 26 AND dayofweek(d) = 1) OR (day(d) = 24 AND dayofweek(d) = 5)))),
       s AS (SELECT d FROM d ANTI JOIN h USING (d) WHERE dayofweek(d) BETWEEN 1 AND 5),
       r AS (SELECT DISTINCT o_orderdate::DATE AS report_date FROM orders)
       SELECT r.report_date::TIMESTAMP AS report_date, ((s.d::TIMESTAMP + INTERVAL 16 HOUR) {NY} AS t_visible
       FROM r ASOF JOIN s ON r.report_date + 3 <= s.d""",
)
def vis_next_session(t: Tables):
    """Weekly report public three days on at the close, holidays roll."""
    r = t.read("orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return r.select(C("d").cast("timestamp_ntz").alias("report_date"), V.weekly_report(C("d")).alias("t_visible"))


@query(
    "vis_monthly",
    """SELECT DISTINCT symbol, bar_open, date_trunc('month', bar_open) + INTERVAL 1 MONTH + INTERVAL 6 DAY + INTERVAL 12 HOUR AS t_visible FROM daily""",
    "daily",
)
def vis_monthly(t: Tables):
    """Seventh of the next month at noon."""
    return t.daily.select("symbol", "bar_open", V.monthly_index(C("bar_open")).alias("t_visible"))


@query(
    "vis_day_lag",
    "SELECT event_id, date_trunc('day', ts) + INTERVAL 30 DAY + INTERVAL 12 HOUR AS t_visible FROM events",
)
def vis_day_lag(t: Tables):
    """Thirty days after observation at noon."""
    return t.read("events").select("event_id", V.day_lag(C("ts")).alias("t_visible"))


@query(
    "vis_first_bday",
    """WITH f AS (SELECT contract, report_date, date_trunc('month', report_date) + INTERVAL 2 MONTH AS d FROM positions_book)
       SELECT contract, report_date, d + to_days(CASE dayofweek(d) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END) + INTERVAL 12 HOUR AS t_visible FROM f""",
    "positions_book",
)
def vis_first_bday(t: Tables):
    """First business day two months later at noon."""
    return t.positions_book.select(
        "contract", "report_date", V.first_business_day(C("report_date")).alias("t_visible")
    )


@query(
    "vis_next_open",
    f"SELECT article_id, ((date_trunc('day', created_at) + INTERVAL 1 DAY + INTERVAL 570 MINUTE) {NY} AS t_visible FROM articles",
    "articles",
)
def vis_next_open(t: Tables):
    """Date-precise news is public at the next day's open."""
    return t.article_times.select("article_id", V.next_open(C("created_at")).alias("t_visible"))


@query(
    "vis_settlement",
    f"""SELECT symbol, bar_open, ((bar_open + to_minutes(CASE symbol WHEN '1-URGENT' THEN 870 WHEN '2-HIGH' THEN 900 ELSE 960 END)) {NY} AS settlement_ts
        FROM daily""",
    "daily",
)
def vis_settlement(t: Tables):
    """Local settlement time per ticker, 16:00 by default."""
    return t.daily.select(
        "symbol", "bar_open", V.settlement(C("bar_open"), C("symbol"), TEST_SETTLEMENT).alias("settlement_ts")
    )


@query("vis_schedule", "SELECT event_type, event_ts, event_ts - INTERVAL 365 DAY AS t_visible FROM schedule", "schedule")
def vis_schedule(t: Tables):
    """Scheduled events are known a year ahead."""
    return t.schedule.select("event_type", "event_ts", V.announced_ahead(C("event_ts")).alias("t_visible"))


@query(
    "publish_time_fallback",
    """WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '2024-02-03T04:05:06' WHEN page_id % 3 = 1 THEN 'soon' END AS meta,
                 CASE WHEN page_id % 2 = 0 THEN '/2024-03-04-slug' ELSE '/slug' END AS slug,
                 strftime(TIMESTAMP '2024-05-01' + to_minutes(page_id), '%Y%m%d%H%M%S') AS capture FROM pages)
       SELECT page_id, CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-02-03 04:05:06'
              WHEN page_id % 2 = 0 THEN TIMESTAMP '2024-03-04' ELSE strptime(capture, '%Y%m%d%H%M%S') END AS published FROM p""",
)
def publish_time_fallback(t: Tables):
    """Page metadata, else date in the address, else capture time."""
    pid = C("page_id")
    meta = F.when(pid % 3 == 0, "2024-02-03T04:05:06").when(pid % 3 == 1, "soon")
    url = F.concat("url", F.when(pid % 2 == 0, "/2024-03-04-slug").otherwise("/slug"))
    start = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    capture = F.date_format(start + F.make_dt_interval(F.lit(0), F.lit(0), pid.cast("int")), "yyyyMMddHHmmss")
    return t.read("pages").select("page_id", published_fallback(meta, url, capture).alias("published"))


@query("event_calendar", "SELECT event_type, event_ts, tier::BIGINT AS tier FROM schedule", "schedule")
def event_calendar(t: Tables):
    """Release schedule over the years the tables span."""
    return t.schedule.select("event_type", "event_ts", "tier")


@query(
    "daily_grid",
    "SELECT unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS day",
)
def daily_grid(t: Tables):
    """Every day between the first and the last order."""
    return day_grid(t.read("orders"), "o_orderdate", "day")


@query(
    "session_phase",
    f"""WITH m AS (SELECT symbol, bar_open, hour((bar_open {ET}) * 60 + minute((bar_open {ET}) AS m FROM bars)
        SELECT symbol, bar_open, (CASE WHEN m < 570 OR m >= 960 THEN -1 WHEN m < 660 THEN 0 WHEN m < 840 THEN 1 WHEN m < 930 THEN 2 ELSE 3 END)::BIGINT AS phase FROM m""",
    "bars",
)
def session_phase(t: Tables):
    """Part of the exchange session a bar starts in."""
    return t.bars.select("symbol", "bar_open", S.session_phase(C("bar_open")).alias("phase"))


@query(
    "session_bar_index",
    f"""WITH m AS (SELECT event_id, ts, hour((ts {ET}) * 60 + minute((ts {ET}) AS m FROM events)
        SELECT event_id, (CASE WHEN m < 570 OR m >= 960 THEN -1 ELSE (m - 570) // 30 END)::BIGINT AS bar_index FROM m""",
)
def session_bar_index(t: Tables):
    """Half-hour number since the open."""
    return t.read("events").select("event_id", S.session_bar_index(C("ts")).alias("bar_index"))


@query(
    "last_bar_of_session",
    f"""WITH d AS (SELECT symbol, bar_close, ((bar_open {ET})::DATE AS sd FROM bars)
        SELECT symbol, bar_close, coalesce(lead(sd) OVER w <> sd, true) AS is_last FROM d WINDOW w AS (PARTITION BY symbol ORDER BY bar_close)""",
    "bars",
)
def last_bar_of_session(t: Tables):
    """Last bar of each local session."""

    def compute(d, w):
        return d.withColumn("is_last", S.is_last_of_session(C("bar_open"), w))

    out = over_rows(t.bars.select("symbol", "bar_open", "bar_close"), BAR, compute, lookback=0, lookahead=1)
    return out.select("symbol", "bar_close", "is_last")


@query(
    "era_label",
    """WITH e AS (SELECT event_type AS kind, event_ts AS ts FROM schedule)
       SELECT kind, ts, (CASE WHEN year(ts) <= 2019 THEN 0 WHEN year(ts) <= 2022 THEN 1 WHEN year(ts) <= 2024 THEN 2 ELSE 3 END)::BIGINT AS era,
              (year(ts) BETWEEN 2016 AND 2019)::BIGINT AS y_2016_2019, (year(ts) BETWEEN 2020 AND 2022)::BIGINT AS y_2020_2022,
              (year(ts) BETWEEN 2023 AND 2024)::BIGINT AS y_2023_2024, (year(ts) >= 2025)::BIGINT AS y_2025_plus FROM e""",
    "schedule",
)
def era_label(t: Tables):
    """Era label and one-hot year buckets."""
    ts = C("event_ts")
    flags = [c.alias(f"y_{n}") for n, c in S.year_buckets(ts).items()]
    return t.schedule.select(C("event_type").alias("kind"), ts.alias("ts"), S.era_label(ts).alias("era"), *flags)


@query(
    "calendar_encodings",
    """SELECT symbol, bar_open, round(sin(2 * pi() * (isodow(bar_open) - 1) / 5.0), 6) + 0.0::DOUBLE AS dow_sin, round(cos(2 * pi() * (isodow(bar_open) - 1) / 5.0), 6) + 0.0::DOUBLE AS dow_cos,
              round(sin(2 * pi() * month(bar_open) / 12.0), 6) + 0.0::DOUBLE AS month_sin, round(cos(2 * pi() * month(bar_open) / 12.0), 6) + 0.0::DOUBLE AS month_cos,
              (isodow(bar_open) = 5 AND day(bar_open) BETWEEN 15 AND 21) AS is_expiry,
              (month(bar_open) IN (3, 6, 9, 12) AND date_diff('day', bar_open::DATE, last_day(bar_open::DATE)) < 3) AS is_quarter_end FROM daily""",
    "daily",
)
def calendar_encodings(t: Tables):
    """Cyclical weekday and month, option expiry and quarter end."""
    ts = C("bar_open")
    ds, dc = S.cyclical(F.weekday(ts), 5.0)
    ms, mc = S.cyclical(F.month(ts), 12.0)
    day = F.to_date(ts)
    return t.daily.select(
        "symbol",
        "bar_open",
        rnd(ds).alias("dow_sin"),
        rnd(dc).alias("dow_cos"),
        rnd(ms).alias("month_sin"),
        rnd(mc).alias("month_cos"),
        S.is_third_friday(day).alias("is_expiry"),
        S.is_quarter_end_window(day).alias("is_quarter_end"),
    )
