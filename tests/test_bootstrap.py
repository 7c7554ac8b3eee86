"""The block bootstrap against a plain loop over its own draws."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import backtest as B
from pitspark.operators.chunked import SeriesKey

C = F.col
KEY = SeriesKey(("s",), "t")


def loop(spark, name: str, pnl: list[float], replicates: int, seed: int = 17) -> np.ndarray:
    """The Sharpe ratio of each replicate, block by block and return by return."""
    n, size = len(pnl), max(1, math.floor(math.cbrt(len(pnl))))
    most = math.ceil(n / size + 8 * math.sqrt(n / size) + 16)
    grid = spark.range(1).select(F.lit(name).alias("s"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b")).select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    u = [((F.pmod(F.xxhash64("s", "b", "k", F.lit(tag), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias(tag) for tag in ("start", "len")]
    out = {}
    for r in grid.select("b", "k", *u).orderBy("b", "k").collect():
        got = out.setdefault(r.b, [])
        want = max(1, math.ceil(math.log(r.len) / math.log(1 - 1 / size))) if size > 1 else 1
        at = math.floor(r.start * n)
        left = n - len(got)
        got += [pnl[(at + j) % n] for j in range(left if r.k == most else min(want, left))]
    rows = np.array([out[b] for b in range(1, replicates + 1)])
    assert rows.shape == (replicates, n)
    sd = rows.std(axis=1)
    return np.where(sd > 1e-12, rows.mean(axis=1) / np.where(sd > 1e-12, sd, 1), 0) * math.sqrt(B.BARS_PER_YEAR)


@pytest.mark.parametrize("small", [0, 200_000])
def test_bootstrap_keeps_every_series(spark, monkeypatch, small):
    """Also one whose key is null, whether the prefix sums are broadcast or shuffled."""
    monkeypatch.setattr(B, "SMALL_TABLE", small)
    monkeypatch.setattr(B, "TASK_DRAWS", 500)
    rng = np.random.default_rng(3)
    series = {"a": rng.normal(0.1, 1, 70).tolist(), None: rng.normal(-0.2, 1, 29).tolist(), "one": [0.5], "few": [0.5, -0.25, 1.0]}
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), x) for s, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, pnl double")
    got = {r.s: r for r in B.bootstrap_sharpe(df, KEY, replicates=40).collect()}
    assert set(got) == set(series)
    for s, xs in series.items():
        want = loop(spark, s, xs, 40)
        low, high = np.quantile(want, [0.025, 0.975])
        assert [got[s].mean_sharpe, got[s].ci_low, got[s].ci_high] == pytest.approx([want.mean(), low, high], rel=1e-6, abs=1e-6), s


def test_bootstrap_of_nothing(spark):
    df = spark.createDataFrame([], "s string, t timestamp_ntz, pnl double")
    assert B.bootstrap_sharpe(df, KEY, replicates=5).collect() == []
