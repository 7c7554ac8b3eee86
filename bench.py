"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Every query is run once to warm up code generation and once for the clock;
results go to the noop sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "feature_snapshot",
    "ohlcv_bars",
    "asof_strict",
    "asof_inclusive",
    "asof_tolerance",
    "asof_multi_series",
    "articles_per_bar",
    "bar_article_slots",
    "event_within_24h",
    "latest_revision",
    "realized_vol",
    "rolling_z",
    "ewm_wilder",
    "macd_signal",
    "time_rolling_mean",
    "tercile_thresholds",
    "walk_forward_folds",
    "label_triple_barrier",
    "pos_donchian",
    "metrics_bundle",
    "raps_quantile",
    "adaptive_ece",
    "bar_anchor_stats",
    "drawdown_breaker",
    "html_articles",
    "table_fingerprint",
)


def main() -> None:
    from pitspark.plans import catalogue
    from pitspark.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(HEADLINE)
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
