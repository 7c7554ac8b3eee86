"""Registry of named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitspark.sources.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Views in ANSI SQL; the value is (needed views, body).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": ((), "SELECT ts, event_id, event_type AS symbol, value AS price FROM events"),
    "bars": (
        ("ticks",),
        """SELECT symbol, date_trunc('hour', ts) AS bar_open,
                  date_trunc('hour', ts) + INTERVAL 60 MINUTE AS bar_close,
                  first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
                  last(price ORDER BY ts, event_id) AS close, count(*) AS volume, avg(price) AS vwap
           FROM ticks GROUP BY 1, 2, 3""",
    ),
    "daily": (
        (),
        """SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS bar_open,
                  date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 1 DAY AS bar_close,
                  first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high,
                  min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderkey) AS close,
                  count(*) AS volume, bool_or(o_orderstatus = 'P') AS news
           FROM orders GROUP BY 1, 2, 3""",
    ),
    "vintages": (
        (),
        """SELECT o_orderpriority AS series_id, o_orderdate AS date,
                  o_orderdate + to_days(l_linenumber) AS realtime_start,
                  round(avg(l_extendedprice), 8) AS value
           FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    ),
    "articles": (
        (),
        """SELECT doc_id AS article_id, source, lang, text AS body,
                  TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919) % 43200) AS created_at,
                  TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919) % 43200) + INTERVAL 60 SECOND AS t_visible
           FROM documents""",
    ),
    "veclong": (
        (),
        """SELECT vec_id AS article_id, label::BIGINT AS label,
                  unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS dim FROM embeddings""",
    ),
    "anchormean": (("veclong",), "SELECT label, dim, avg(v) AS m FROM veclong GROUP BY 1, 2"),
    "anchors": (
        ("anchormean",),
        """SELECT a.label, a.dim, a.m / n.norm AS a FROM anchormean a
           JOIN (SELECT label, sqrt(sum(m * m)) AS norm FROM anchormean GROUP BY 1) n USING (label)""",
    ),
    "scorelong": (
        ("veclong", "anchors"),
        """SELECT v.article_id AS row_id, any_value(v.label) AS label, a.label AS class,
                  round(10.0 * sum(v.v * a.a) / (sqrt(sum(v.v * v.v)) * sqrt(sum(a.a * a.a))), 6) AS logit,
                  (v.article_id // 2) % 2 AS fold,
                  CASE WHEN (v.article_id // 4) % 2 = 0 THEN 'b' ELSE 'c' END AS slice,
                  v.article_id % 2 = 1 AS present
           FROM veclong v JOIN anchors a USING (dim) GROUP BY v.article_id, a.label""",
    ),
    "positions_book": (
        (),
        """SELECT l_suppkey AS contract, date_trunc('month', l_shipdate)::TIMESTAMP AS report_date,
                  sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS longs,
                  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS shorts,
                  sum(l_quantity) AS total
           FROM lineitem GROUP BY 1, 2""",
    ),
}


def _decision_days() -> str:
    from pitspark.functions.fixed import RATE_DECISIONS

    days = [f"(DATE '{y}-{m:02d}-{d:02d}')" for y, ds in RATE_DECISIONS.items() for m, d in ds]
    return "(VALUES " + ", ".join(days) + ") v(d)"


VIEWS["schedule"] = (
    (),
    f"""SELECT event_type, (((day + to_minutes(minute)) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS event_ts, tier FROM (
        SELECT 'NFP' AS event_type, m + ((12 - dayofweek(m)) % 7)::INT AS day, 510 AS minute, 1 AS tier FROM months
        UNION ALL SELECT 'CPI', (m + 11) + (CASE dayofweek(m + 11) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END), 510, 1 FROM months
        UNION ALL SELECT 'JOLTS', (m + 8) + (CASE dayofweek(m + 8) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END), 600, 2 FROM months
        UNION ALL SELECT 'PCE', last_day(m) - (CASE dayofweek(last_day(m)) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END), 510, 1 FROM months
        UNION ALL SELECT 'GDP', last_day(m) - ((dayofweek(last_day(m)) + 3) % 7)::INT, 510, 1 FROM months WHERE month(m) IN (1, 4, 7, 10)
        UNION ALL SELECT 'FOMC', d, 840, 1 FROM {_decision_days()}, yrs WHERE year(d) BETWEEN y0 AND y1
        UNION ALL SELECT 'FOMC_minutes', d + 21, 840, 2 FROM {_decision_days()}, yrs WHERE year(d) BETWEEN y0 AND y1)""",
)
VIEWS["yrs"] = ((), "SELECT (SELECT year(min(o_orderdate)) FROM orders) AS y0, (SELECT year(max(ts)) FROM events) AS y1")
VIEWS["months"] = (
    ("yrs",),
    "SELECT unnest(generate_series(make_date(y0, 1, 1), make_date(y1, 12, 1), INTERVAL 1 MONTH))::DATE AS m FROM yrs",
)
VIEWS["schedule"] = (("yrs", "months"), VIEWS["schedule"][1])


def view(name: str, body: str, needs: str = "") -> None:
    """Declare a helper view of the checks."""
    VIEWS[name] = (tuple(needs.split()), body)


def sql_with(needs: str, body: str) -> str:
    """Prefix a query with the CTEs of the views it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body.lstrip()[len('WITH RECURSIVE '):]}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes},\n{body.lstrip()[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register a query over :class:`Tables` together with its check."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql_with(needs, sql)
        return fn

    return wrap
