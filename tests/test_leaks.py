"""The leak check itself: quiet for what looks back, loud for what peeks."""

import datetime as dt

from pyspark.sql import functions as F

from pitspark.operators.chunked import SeriesKey, over_rows
from pitspark.operators.leaks import prefix_changes

T0 = dt.datetime(2024, 1, 1)


def test_counts_changes_at_every_cut(spark):
    rows = [(s, T0 + dt.timedelta(hours=i), float(i * i % 7)) for s in ("a", None) for i in range(50)]
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, x double")
    key = SeriesKey(("s",), "t", (), 36_000)

    def op(d, k):
        def compute(q, w):
            return q.withColumns({"back": F.lag("x", 2).over(w), "ahead": F.lead("x", 2).over(w), "mean": F.avg("x").over(w.rowsBetween(-3, 0))})

        out = over_rows(d, k, compute, lookback=3, lookahead=2, block_rows=8)
        total = d.groupBy("cut_no").agg(F.sum("x").alias("total"))
        return out.join(total, "cut_no")

    cuts = [T0 + dt.timedelta(hours=10), T0 + dt.timedelta(hours=33, minutes=1), T0 + dt.timedelta(hours=900), T0 - dt.timedelta(hours=1)]
    got = {(r["value"], r["cut"]): (r.n_rows, r.n_changed) for r in prefix_changes(df, key, cuts, op, ["back", "ahead", "mean", "total"]).collect()}
    for cut, n in zip(cuts[:3], (11, 34, 50)):
        assert got["back", cut] == got["mean", cut] == (2 * n, 0)
        assert got["ahead", cut] == (2 * n, 4 if n < 50 else 0)
        assert got["total", cut] == (2 * n, 2 * n if n < 50 else 0)
    assert not any(cut == cuts[3] for _, cut in got)  # no row is that early
