"""Streaming operators against their batch twins."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitspark.operators.sequential import breaker_step
from pitspark.streaming import bars as SB
from pitspark.streaming import enrich, stateful

T0 = dt.datetime(2024, 1, 15, 14, 0)
SCHEMA = "symbol string, ts timestamp, event_id long, price double"


def ticks(n=200, seed=3):
    rng = np.random.default_rng(seed)
    secs = np.sort(rng.integers(0, 6 * 3600, n))
    return [(("A", "B")[i % 2], T0 + dt.timedelta(seconds=int(s)), i, float(round(rng.uniform(1, 9), 2))) for i, s in enumerate(secs)]


def stream_of(spark, tmp_path, batches, schema):
    """A file stream with one micro-batch per given list of rows."""
    src = tmp_path / "src"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"b{i}"))
        src.mkdir(exist_ok=True)
        part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
        target = src / f"{i:03d}.parquet"
        part.rename(target)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def drain(df, tmp_path, name, mode="append"):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return q


def test_stream_bars_equal_batch(spark, tmp_path):
    rows = ticks()
    late_flush = [("A", T0 + dt.timedelta(days=2), 10_000, 1.0)]
    s = stream_of(spark, tmp_path, [rows[:100], rows[100:], late_flush, late_flush], SCHEMA)
    drain(SB.stream_bars(s, seconds=1800, lateness="10 minutes"), tmp_path, "sbars")
    got = {(r.symbol, r.bar_open): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("sbars").collect()}
    from pitspark.sources.views import ohlcv

    batch = ohlcv(spark.createDataFrame(rows, SCHEMA), seconds=1800)
    want = {(r.symbol, r.bar_open): (r.open, r.high, r.low, r.close, r.volume) for r in batch.collect()}
    assert got == want


def test_dedupe_articles(spark, tmp_path):
    schema = "article_id long, created_at timestamp"
    a = [(i, T0 + dt.timedelta(minutes=i)) for i in range(20)]
    s = stream_of(spark, tmp_path, [a[:12], a[6:], a[:5]], schema)
    drain(SB.dedupe_articles(s), tmp_path, "dedup")
    assert sorted(r.article_id for r in spark.table("dedup").collect()) == list(range(20))


def test_articles_per_bar_is_right_inclusive(spark, tmp_path):
    schema = "article_id long, created_at timestamp"
    # Visible 14:30:00 exactly, 14:30:01 and 15:00:00.
    a = [(1, T0 + dt.timedelta(minutes=29)), (2, T0 + dt.timedelta(minutes=29, seconds=1)), (3, T0 + dt.timedelta(minutes=59))]
    s = stream_of(spark, tmp_path, [a, [(9, T0 + dt.timedelta(days=1))], [(9, T0 + dt.timedelta(days=1))]], schema)
    drain(SB.articles_per_bar(s, seconds=1800, lateness="5 minutes"), tmp_path, "napb")
    got = {r.bar_close: r.news_count for r in spark.table("napb").collect()}
    assert got == {T0 + dt.timedelta(minutes=30): 1, T0 + dt.timedelta(minutes=60): 2}


@pytest.mark.parametrize("which", ["breaker", "alpha", "stop"])
def test_recursions_apply_in_time_order(spark, tmp_path, which):
    rng = np.random.default_rng(5)
    n = 240
    if which == "breaker":
        x = np.exp(np.cumsum(rng.normal(-0.004, 0.02, n)))
        rec = stateful.DrawdownBreaker()
    elif which == "alpha":
        x = (rng.uniform(size=n) < 0.2).astype(float)
        rec = stateful.AdaptiveAlpha()
    else:
        x = 100 + np.cumsum(rng.normal(0, 1, n))
        rec = stateful.TrailingStop(hard=4.0, trail=3.0)
    rows = [("k", T0 + dt.timedelta(minutes=i), float(v)) for i, v in enumerate(x)]
    mixed = [rows[i] for i in rng.permutation(120)]
    schema = "key string, at timestamp, x double"
    end = [("k", T0 + dt.timedelta(days=3), 1.0)]
    s = stream_of(spark, tmp_path, [mixed, [rows[i] for i in 120 + rng.permutation(120)], end, end], schema)
    out = stateful.run_recursion(s, rec, key="key", time="at", value="x", out="y", lateness="3 hours")
    drain(out, tmp_path, f"rec_{which}")
    core, want = rec.start(), []
    for v in x:
        core, y = rec.step(core, float(v))
        want.append(y)
    got = [r.y for r in spark.table(f"rec_{which}").filter(F.col("at") < F.lit(T0 + dt.timedelta(days=1))).orderBy("at").collect()]
    assert np.allclose(got, want)


def test_breaker_recovers_after_total_halt_rows():
    state, halted, count = 0, False, 0
    seen = []
    for _ in range(70):
        state, halted, count = breaker_step(3, halted, count)
        seen.append(state)
    assert seen[:65] == [3] * 65 and seen[65] == 0 and seen[66] == 3


def test_enrich_asof(spark, tmp_path):
    schema = "symbol string, ts timestamp, event_id long, price double"
    rows = ticks(40)
    s = stream_of(spark, tmp_path, [rows[:20], rows[20:]], schema)
    table = spark.createDataFrame([(T0 + dt.timedelta(hours=h), float(h)) for h in range(7)], "rel timestamp, v double")
    out = str(tmp_path / "out")
    q = enrich.enrich_asof(
        s, lambda: table, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"),
        left_time="ts", right_time="rel", columns=["v"], checkpoint=str(tmp_path / "cp"),
    )
    q.awaitTermination(120)
    got = {r.event_id: r.v for r in spark.read.parquet(out).collect()}
    for _, ts, i, _ in rows:
        before = [h for h in range(7) if T0 + dt.timedelta(hours=h) < ts]
        assert got[i] == (float(before[-1]) if before else None)
    assert pd.Series(got).size == 40
