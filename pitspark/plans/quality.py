"""Contract and data-quality checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pitspark.functions.timefn import shift_seconds
from pitspark.operators import quality as Q
from pitspark.operators import rolling as R
from pitspark.operators.chunked import Ewm, SeriesKey, over_rows, with_ewm
from pitspark.operators.leaks import prefix_changes
from pitspark.plans.registry import query
from pitspark.sources.contracts import Contract, value_violations
from pitspark.sources.views import BAR, HOUR, Tables

C = F.col


@query(
    "validate_nulls",
    """WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
       v AS (SELECT * FROM (SELECT count(*) FILTER (WHERE doc_id IS NULL) AS a, count(*) FILTER (WHERE quality IS NULL) AS b,
             count(*) FILTER (WHERE toxic IS NULL) AS c FROM j))
       SELECT 'null quality' AS rule, b AS n FROM v WHERE b > 0 UNION ALL SELECT 'null toxic', c FROM v WHERE c > 0""",
)
def validate_nulls(t: Tables):
    """Broken value rules of a contract with their row counts."""
    j = t.read("documents").select("doc_id", "lang").join(t.read("labels"), "doc_id", "left")
    contract = Contract.of("labelled", "doc_id long, lang string?, quality long, toxic long", ["doc_id"])
    return value_violations(j, contract)


@query(
    "pit_violations",
    """SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       WHERE o_orderdate > l_shipdate GROUP BY 1""",
)
def pit_violations(t: Tables):
    """Rows visible before release, counted per class."""
    li = t.read("lineitem").select("l_orderkey", "l_returnflag", C("l_shipdate").alias("t_visible"))
    od = t.read("orders").select("o_orderkey", C("o_orderdate").alias("release_ts"))
    j = li.join(od, C("l_orderkey") == C("o_orderkey"))
    return Q.late_release(j).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lookahead_violations",
    """WITH p AS (SELECT bar_open AS day, bar_close AS t_visible_close, bar_open AS t_visible_open,
                  CASE WHEN volume > 3 THEN bar_open + INTERVAL 1 HOUR ELSE bar_open END AS t_visible_late FROM daily)
       SELECT 't_visible_close' AS "column", count(*) FILTER (WHERE t_visible_close > day) AS n FROM p
       UNION ALL SELECT 't_visible_open', count(*) FILTER (WHERE t_visible_open > day) FROM p
       UNION ALL SELECT 't_visible_late', count(*) FILTER (WHERE t_visible_late > day) FROM p""",
    "daily",
)
def lookahead_violations(t: Tables):
    """Panel cells that became visible after the panel day."""
    late = F.when(C("volume") > 3, shift_seconds(C("bar_open"), HOUR)).otherwise(C("bar_open"))
    p = t.daily.select(
        C("bar_open").alias("day"),
        C("bar_close").alias("t_visible_close"),
        C("bar_open").alias("t_visible_open"),
        late.alias("t_visible_late"),
    )
    return Q.lookahead_counts(p, "day", ["t_visible_close", "t_visible_open", "t_visible_late"])


@query(
    "pk_duplicates",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def pk_duplicates(t: Tables):
    """Primary keys that occur more than once."""
    return Q.duplicate_keys(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "degenerate_columns",
    """WITH p AS (SELECT l_quantity AS qty, l_discount AS disc, NULL::DOUBLE AS void, l_tax * 0 + 1 AS flat FROM lineitem)
       SELECT 'qty' AS "column", count(qty) AS n_values, count(qty) = 0 AS all_null, coalesce(min(qty) = max(qty), false) AS constant FROM p
       UNION ALL SELECT 'disc', count(disc), count(disc) = 0, coalesce(min(disc) = max(disc), false) FROM p
       UNION ALL SELECT 'void', count(void), count(void) = 0, coalesce(min(void) = max(void), false) FROM p
       UNION ALL SELECT 'flat', count(flat), count(flat) = 0, coalesce(min(flat) = max(flat), false) FROM p""",
)
def degenerate_columns(t: Tables):
    """Constant and all-null columns."""
    p = t.read("lineitem").select(
        C("l_quantity").alias("qty"),
        C("l_discount").alias("disc"),
        F.lit(None).cast("double").alias("void"),
        (C("l_tax") * 0 + 1).alias("flat"),
    )
    return Q.degenerate_columns(p, ["qty", "disc", "void", "flat"])


@query(
    "missing_series",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def missing_series(t: Tables):
    """Expected keys that have no row at all."""
    actual = t.read("orders").filter(C("o_orderstatus") == "P").select(C("o_custkey").alias("c_custkey"))
    return Q.missing_keys(t.read("customer"), actual, ["c_custkey"])


@query(
    "missing_bars",
    """WITH e AS (SELECT symbol, min(bar_open) AS lo, max(bar_open) AS hi FROM bars GROUP BY 1),
            g AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS bar_open FROM e)
       SELECT g.symbol, g.bar_open FROM g ANTI JOIN bars b ON b.symbol = g.symbol AND b.bar_open = g.bar_open""",
    "bars",
)
def missing_bars(t: Tables):
    """Hours between a symbol's first and last bar without a bar."""
    return Q.missing_slots(t.bars.select("symbol", "bar_open"), by="symbol", time="bar_open", seconds=HOUR)


@query(
    "non_monotonic",
    """WITH x AS (SELECT event_type AS symbol, event_id, ts, value, lag(ts) OVER (PARTITION BY event_type ORDER BY value, event_id) AS prev_ts FROM events)
       SELECT symbol, event_id, ts, prev_ts FROM x WHERE prev_ts >= ts""",
)
def non_monotonic(t: Tables):
    """Rows that are not later than their predecessor in arrival order."""
    e = t.read("events").select(C("event_type").alias("symbol"), "event_id", "ts", "value")
    key = SeriesKey(("symbol",), "value", ("event_id",))
    # Chunks run along the arrival order, here the event value.
    out = Q.non_monotonic(e, key, "ts", chunk=F.floor(C("value") / 50))
    return out.select("symbol", "event_id", "ts", "prev_ts")


CUTS = (dt.datetime(2024, 1, 8, 12), dt.datetime(2024, 1, 15, 7), dt.datetime(2024, 1, 22, 23))


@query(
    "prefix_stability",
    """WITH c AS (SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-08 12:00:00'), (2, TIMESTAMP '2024-01-15 07:00:00'), (3, TIMESTAMP '2024-01-22 23:00:00')) v(no, cut)),
       g AS (SELECT 0 AS no, symbol, bar_close, close FROM bars UNION ALL SELECT no, symbol, bar_close, close FROM bars JOIN c ON bar_close <= cut),
       n AS (SELECT no, symbol, bar_close, close - lag(close) OVER w AS change_1, avg(close) OVER (w ROWS 19 PRECEDING) AS mean_20, stddev_samp(close) OVER (w ROWS 7 PRECEDING) AS std_8,
               max(close) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS high_20, lead(close) OVER w - close AS next_change FROM g WINDOW w AS (PARTITION BY no, symbol ORDER BY bar_close)),
       u AS (SELECT no, symbol, bar_close, unnest(['change_1', 'mean_20', 'std_8', 'high_20', 'ewm_14', 'next_change']) AS value, unnest([change_1, mean_20, std_8, high_20, 0, next_change]) AS v FROM n)
       SELECT p.value, c.cut, count(*) AS n_rows, count(*) FILTER (WHERE round(p.v, 6) IS DISTINCT FROM round(w.v, 6)) AS n_changed
       FROM u p JOIN u w ON w.no = 0 AND p.symbol = w.symbol AND p.bar_close = w.bar_close AND p.value = w.value JOIN c ON p.no = c.no GROUP BY 1, 2""",
    "bars",
)
def prefix_stability(t: Tables):
    """Leak check: five windowed values that never change when the future goes, and one (the next change) that does."""

    def op(df, key):
        def compute(d, w):
            x = C("close")
            d = with_ewm(d, w, {"ewm_14": Ewm(x, 1 / 14)})
            return d.withColumns(
                {"change_1": R.diff(x, 1, w), "mean_20": R.mean(x, 20, 20, w), "std_8": R.std(x, 8, 8, w), "high_20": R.channel(x, x, 20, w)[0], "next_change": F.lead(x).over(w) - x}
            )

        return over_rows(df, key, compute, lookback=20, lookahead=1)

    values = ["change_1", "mean_20", "std_8", "high_20", "ewm_14", "next_change"]
    return prefix_changes(t.bars.select("symbol", "bar_close", "close"), BAR, CUTS, op, values, places=6)
