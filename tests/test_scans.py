"""Scans over the block table as a tree: many blocks, small fan, several series, against plain loops."""

import datetime as dt

import numpy as np
import pytest

from pitspark.operators import chunked, sequential
from pitspark.operators.chunked import SeriesKey
from pitspark.operators.sequential import SIZES, adaptive_alpha, breaker_step, drawdown_breaker, expert_discount, initial_alphas, step_alphas, step_weights

T0 = dt.datetime(2024, 1, 1)
KEY = SeriesKey(("s",), "t", (), 86_400)


def frame(spark, name, series):
    rows = [(s, T0 + dt.timedelta(minutes=i), float(v)) for s, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"s string, t timestamp_ntz, {name} double")


def paths():
    """Equity paths that stay halted for long, touch every level and recover."""
    rng = np.random.default_rng(2)
    wild = np.exp(np.cumsum(rng.normal(0, 0.03, 700)))
    stuck = np.concatenate((np.ones(10), np.full(500, 0.8), np.linspace(0.8, 1.2, 60), np.full(30, 1.08)))
    return {"wild": wild, "stuck": stuck, None: wild[::-1][:100], "one": np.ones(1)}


def loop(equity):
    peak, halted, count, sizes = 1.0, False, 0, []
    for e in equity:
        peak = max(peak, e)
        dd = (e - peak) / peak
        level = 3 if dd <= -0.15 + 1e-9 else 2 if dd <= -0.10 + 1e-9 else 1 if dd <= -0.05 + 1e-9 else 0
        state, halted, count = breaker_step(level, halted, count)
        sizes.append(SIZES[state])
    return sizes


@pytest.mark.parametrize(("block_rows", "fan"), [(7, 3), (50_000, 1024)])
def test_breaker(spark, block_rows, fan):
    got = drawdown_breaker(frame(spark, "equity", paths()), KEY, equity="equity", block_rows=block_rows, fan=fan).orderBy("t").collect()
    for s, values in paths().items():
        assert [r.size_multiplier for r in got if r.s == s] == loop(values)


@pytest.mark.parametrize(("block_rows", "fan"), [(11, 3), (50_000, 1024)])
def test_adaptive_level(spark, block_rows, fan):
    rng = np.random.default_rng(3)
    series = {"calm": (rng.random(400) < 0.1) * 1.0, "bad": np.ones(150), None: (rng.random(90) < 0.5) * 1.0}
    got = adaptive_alpha(frame(spark, "missed", series), KEY, missed="missed", block_rows=block_rows, fan=fan).orderBy("t").collect()
    for s, values in series.items():
        a, w = initial_alphas(), np.full(5, 0.2)
        rows = [r for r in got if r.s == s]
        for r, m in zip(rows, values, strict=True):
            assert abs(r.alpha - np.clip(w @ a, 0.001, 0.5)) < 1e-9
            a = step_alphas(a, m)
            w = step_weights(w, expert_discount(a, m))
            assert abs(r.alpha_next - np.clip(w @ a, 0.001, 0.5)) < 1e-9


def test_no_task_holds_more_than_fan_composites(spark, monkeypatch):
    """Composites beyond the bound would fail: the largest stack that any task walks is reported through an error."""
    stack = chunked._stack

    def small(members):
        out = stack(members)
        if len(out) > 3:
            raise AssertionError(f"{len(out)} composites in one task")
        return out

    monkeypatch.setattr(chunked, "_stack", small)
    equity = paths()["wild"]
    got = drawdown_breaker(frame(spark, "equity", {"a": equity}), KEY, equity="equity", block_rows=20, fan=3).orderBy("t").collect()
    assert [r.size_multiplier for r in got] == loop(equity)


@pytest.mark.parametrize("level", range(4))
def test_runs_equal_steps(level):
    states = np.arange(2 * 65)
    for n in (1, 2, 64, 65, 66, 67, 131, 132, 133, 400):
        halted, count = sequential._behind(level, n, states % 2 == 1, states // 2)
        for i in states:
            h, c = bool(i % 2), int(i // 2)
            for _ in range(n):
                _, h, c = breaker_step(level, h, c)
            assert (bool(halted[i]), int(count[i])) == (h, c), (level, n, i)
