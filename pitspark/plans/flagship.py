"""The pipeline end to end: bars, point-in-time news, features and label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.functions.mathfn import rnd, safe_ln
from pitspark.operators import rolling as R
from pitspark.operators.asof import asof_join
from pitspark.operators.chunked import over_rows
from pitspark.operators.labels import fixed_label
from pitspark.plans.registry import query
from pitspark.sources.views import BAR, Tables

C = F.col


@query(
    "feature_snapshot",
    """WITH f AS (SELECT symbol, bar_close, close, rn, r1, ln(lead(close) OVER o) - ln(close) AS nr,
                  CASE WHEN count(r1) OVER w >= 4 THEN stddev_samp(r1) OVER w END AS rv FROM returns
                  WINDOW o AS (PARTITION BY symbol ORDER BY bar_close), w AS (PARTITION BY symbol ORDER BY bar_close ROWS 7 PRECEDING))
       SELECT f.symbol, f.bar_close, f.close, a.article_id, round(r1, 6) + 0.0 AS log_return_1, round(rv, 6) AS realized_vol_8,
              CASE WHEN nr > 0.0005 THEN 2 WHEN nr < -0.0005 THEN 0 WHEN nr IS NOT NULL THEN 1 END::BIGINT AS label
       FROM f ASOF LEFT JOIN (SELECT t_visible, max(article_id) AS article_id FROM articles GROUP BY 1) a ON f.bar_close > a.t_visible""",
    "returns articles",
)
def snapshot(t: Tables) -> DataFrame:
    """Bars with the latest visible article, lag-safe features and a label."""

    def compute(d, w):
        d = d.withColumns(
            {"c1": F.lag("close").over(w), "next_return": safe_ln(F.lead("close").over(w)) - safe_ln(C("close"))}
        )
        d = d.withColumn("log_return_1", R.log_return(C("c1"), 1, w))
        return d.withColumn("realized_vol_8", R.std(C("log_return_1"), 8, 4, w))

    feats = over_rows(t.bars.select("symbol", "bar_close", "close"), BAR, compute, lookback=9, lookahead=1)
    seen = asof_join(
        feats,
        t.article_times,
        left_time="bar_close",
        right_time="t_visible",
        strict=True,
        columns=["article_id"],
        tie=["article_id"],
    )
    return seen.select(
        "symbol",
        "bar_close",
        "close",
        "article_id",
        rnd(C("log_return_1")).alias("log_return_1"),
        rnd(C("realized_vol_8")).alias("realized_vol_8"),
        fixed_label(C("next_return")).alias("label"),
    )


def run(spark: SparkSession, path: str) -> DataFrame:
    return snapshot(Tables(spark, path))
