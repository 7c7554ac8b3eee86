"""Two-state chain against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import chain as CH
from pitspark.operators.chunked import SeriesKey

T0 = dt.datetime(2024, 1, 1)
KEY = SeriesKey(("s",), "t", (), 50_000)


def simulated(seed, n):
    rng = np.random.default_rng(seed)
    state, out = 0, []
    for _ in range(n):
        state = state if rng.random() < 0.97 else 1 - state
        out.append((abs(rng.normal(0, (0.5, 1.5)[state])), (1.0, 2.0)[state] + rng.normal(0, 0.4)))
    return np.array(out)


def forward(c, x):
    p, out = None, []
    for row, e in zip(x, c.emissions(x)):
        p = c.start * e if p is None else (p @ c.step) * e
        p = p / p.sum()
        out.append(p)
    return np.array(out)


def baum_welch(c, xs):
    """One plain step over several sequences; also the log likelihood before it."""
    stats, loglik = 0, 0.0
    for x in xs:
        logs = -0.5 * ((x[:, None, :] - c.mean) ** 2 / c.var + np.log(2 * np.pi * c.var)).sum(axis=2)
        e = np.exp(logs)
        alpha, scale = np.zeros((len(x), 2)), np.zeros(len(x))
        for t in range(len(x)):
            a = c.start * e[0] if t == 0 else (alpha[t - 1] @ c.step) * e[t]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        beta = np.ones((len(x), 2))
        for t in range(len(x) - 2, -1, -1):
            beta[t] = c.step @ (e[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        moves = sum(alpha[t][:, None] * c.step * e[t + 1] * beta[t + 1] / scale[t + 1] for t in range(len(x) - 1))
        stats = stats + np.concatenate((gamma.sum(0), (gamma.T @ x).ravel(), (gamma.T @ x**2).ravel(), np.ravel(moves), gamma[0]))
        loglik += np.log(scale).sum()
    return CH.maximised(stats, 2, c), loglik


@pytest.fixture(scope="module")
def data(spark):
    series = {("a", 0): simulated(1, 700), ("b", 0): simulated(2, 300), ("a", 1): simulated(3, 400), ("c", 2): simulated(4, 50), (None, 1): simulated(5, 150)}
    rows = [(s, f, T0 + dt.timedelta(minutes=i), float(a), None if i % 50 == 7 else float(r), i < 0.8 * len(x)) for (s, f), x in series.items() for i, (a, r) in enumerate(x)]
    df = spark.createDataFrame(rows, "s string, fold int, t timestamp_ntz, a double, rv double, train boolean").repartition(3).cache()
    keep = {k: np.array([v for i, v in enumerate(x) if i % 50 != 7]) for k, x in series.items()}
    train = {k: np.array([v for i, v in enumerate(x) if i % 50 != 7 and i < 0.8 * len(x)]) for k, x in series.items()}
    return df, keep, train


@pytest.mark.parametrize(("block_rows", "fan"), [(13, 3), (50_000, 1024)])
def test_filter_equals_a_forward_loop(data, block_rows, fan):
    df, keep, _ = data
    chains = CH.fit_chains(df, "fold", KEY, ["a", "rv"], F.col("train"), turns=0)
    assert set(chains) == {0, 1}  # fold 2 has too few rows
    got = CH.filtered(df, "fold", KEY, ["a", "rv"], chains, "p", block_rows=block_rows, fan=fan).orderBy("t").collect()
    assert len(got) == df.count()
    for (s, f), x in keep.items():
        rows = [r for r in got if r.s == s and r.fold == f]
        assert all(r.p == 0.5 for r in rows if r.rv is None or f == 2)
        if f != 2:
            p = [r.p for r in rows if r.rv is not None]
            assert np.allclose(p, forward(chains[f], x)[:, chains[f].high()], atol=1e-9)


def test_em_equals_plain_baum_welch_and_gains(data):
    df, _, train = data
    first = CH.fit_chains(df, "fold", KEY, ["a", "rv"], F.col("train"), turns=0)
    got = CH.fit_chains(df, "fold", KEY, ["a", "rv"], F.col("train"), turns=4)
    for f, c in first.items():
        xs, gains = [x for (_, k), x in train.items() if k == f], []
        for _ in range(4):
            c, loglik = baum_welch(c, xs)
            gains.append(loglik)
        assert all(b > a for a, b in zip(gains, gains[1:]))
        for name in ("start", "step", "mean", "var"):
            assert np.allclose(getattr(got[f], name), getattr(c, name), rtol=1e-6), name
        assert abs(got[f].step[0, 0] - 0.97) < 0.03 and abs(got[f].mean[got[f].high(), 1] - 2) < 0.15


def test_filter_does_not_look_ahead(data):
    df, _, _ = data
    chains = CH.fit_chains(df, "fold", KEY, ["a", "rv"], F.col("train"), turns=0)
    cut = F.col("t") <= F.lit(T0 + dt.timedelta(minutes=200))
    run = lambda d: CH.filtered(d, "fold", KEY, ["a", "rv"], chains, "p", block_rows=64).withColumn("p", F.round("p", 9))
    a, b = run(df).filter(cut), run(df.filter(cut))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
