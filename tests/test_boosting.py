"""Boosted trees against a plain version."""

import math

import numpy as np
from pyspark.sql import functions as F

from pitspark.operators import boosting


def sample(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0.5, 2, np.where(x[:, 1] > 0, 1, 0))
    y = np.where(rng.random(n) < 0.05, rng.integers(0, 3, n), y)
    x[::37, 2] = np.nan
    return x, y


def plain(b, y, rounds, depth, rate, n_bins):
    """The same trees by sorting rows into nodes; returns margins after each round."""
    m, out = np.zeros((len(y), 3)), []
    for _ in range(rounds):
        p = boosting.softmax(m)
        new = m.copy()
        for k in range(3):
            g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])
            stack = [(np.arange(len(y)), 0)]
            while stack:
                rows, level = stack.pop()
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1.0)  # noqa: B023, E731
                best = (1e-12, None)
                for f in range(b.shape[1]):
                    for cut in range(n_bins - 1):
                        left, right = rows[b[rows, f] <= cut], rows[b[rows, f] > cut]
                        if level < depth and h[left].sum() >= 1 and h[right].sum() >= 1:
                            gain = score(left) + score(right) - score(rows)
                            if gain > best[0] + 1e-9:
                                best = (gain, (left, right))
                if best[1] is None:
                    new[rows, k] += -rate * g[rows].sum() / (h[rows].sum() + 1.0)
                else:
                    stack += [(part, level + 1) for part in best[1]]
        m = new
        out.append(m)
    return out


def test_trees_equal_the_plain_version_and_loss_falls(spark):
    x, y = sample()
    rows = [(*(None if math.isnan(v) else float(v) for v in r), int(k)) for r, k in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int").repartition(3)
    edges = [np.linspace(-1.5, 1.5, 7)] * 3
    model = boosting.fit(df, ["a", "b", "c"], F.col("y"), rounds=6, depth=2, rate=0.3, edges=edges, keep_every=2)
    want = plain(model.binned(x).astype(int), y, 6, 2, 0.3, 9)
    got = boosting.margins(model.binned(x), np.zeros((len(x), 3)), model.rounds, 2)
    assert np.allclose(got, want[-1], atol=1e-9)
    assert len(model.losses) == 6 and abs(model.losses[0] - math.log(3)) < 1e-12
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    out = boosting.with_class(df, ["a", "b", "c"], model, "k")
    assert out.columns == ["a", "b", "c", "y", "k"]
    assert np.mean([r.k == r.y for r in out.collect()]) > 0.85


def test_own_edges_missing_columns_and_one_class(spark):
    df = spark.createDataFrame([(float(i), None, i % 2) for i in range(200)], "a double, b double, y int")
    model = boosting.fit(df, ["a", "b"], F.col("y"), rounds=2, depth=2)
    assert len(model.edges) == 2 and model.probabilities(np.array([[1.0, np.nan]])).shape == (1, 3)
