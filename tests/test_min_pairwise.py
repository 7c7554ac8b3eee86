"""Exact smallest pairwise cosine against all pairs."""

import numpy as np
import pytest

from pitspark.operators import vectors as V


def tables(spark, groups):
    rows = [(c, i, [float(x) for x in v]) for c, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "label long, id long, vec array<double>")
    return df, V.anchor_vectors(df, by="label", vec="vec")


def smallest(vs):
    u = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    d = u @ u.T
    return float(d[np.triu_indices(len(u), 1)].min())


@pytest.mark.parametrize("block", [7, 64])
def test_equals_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=(150, 8)), 1: 3 + rng.normal(size=(200, 8)), 2: np.repeat(rng.normal(size=(2, 8)), 20, axis=0)}
    df, anchors = tables(spark, groups)
    got = {r.label: r for r in V.min_pairwise(df, anchors, by="label", id="id", vec="vec", block=block).collect()}
    for c, vs in groups.items():
        assert got[c].n == len(vs) and got[c].min_pairwise == pytest.approx(smallest(vs), abs=1e-12)


def test_a_tight_class_with_outliers_needs_few_comparisons(spark):
    rng = np.random.default_rng(5)
    vs = np.concatenate([5 + 0.1 * rng.normal(size=(1500, 6)), 5 + 4 * rng.normal(size=(12, 6))])
    df, anchors = tables(spark, {0: vs})
    row = V.min_pairwise(df, anchors, by="label", id="id", vec="vec", block=100).first()
    assert row.min_pairwise == pytest.approx(smallest(vs), abs=1e-12)
    assert 0 < row.compared < 1512 * 1511 / 2 / 50


def test_odd_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, None), (1, 2, [0.0, 0.0]), (2, 0, [1.0, 1.0]), (2, 1, [-1.0, 1.0]), (None, 0, [1.0, 2.0]), (None, 1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "label long, id long, vec array<double>")
    anchors = V.anchor_vectors(df.filter("vec is not null"), by="label", vec="vec")
    got = {r.label: (r.n, r.min_pairwise) for r in V.min_pairwise(df, anchors, by="label", id="id", vec="vec").collect()}
    assert got[1] == (1, None)
    assert got[2][0] == 2 and got[2][1] == pytest.approx(0.0, abs=1e-12)
    assert got[None][0] == 2 and got[None][1] == pytest.approx(1.0)
    none = V.min_pairwise(df.limit(0), anchors.limit(0), by="label", id="id", vec="vec")
    assert none.count() == 0
