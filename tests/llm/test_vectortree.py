"""Nearest neighbours against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.llm import vectortree

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, leaf int, v string, kind string, rank int"


def write(spark, path, rows):
    spark.createDataFrame([(*r, 1, "r", 2, "v", "k", 3) for r in rows], SCHEMA).repartition(4).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def usable(v):
    return v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, k=20):
    """Per row that is a query: all candidates as (score, id), best first."""
    kept = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if usable(v)]
    x = np.stack([v for _, v in kept])
    out = defaultdict(list)
    for at, (i, v) in enumerate(kept):
        if i is not None and i % 20 == 0:
            score = (v * x).sum(axis=1)
            out[i].append(sorted(((-s, j is None, j or 0) for n, (s, (j, _)) in enumerate(zip(score, kept)) if n != at)))
    return out


def gaussian(n, seed, width=32):
    v = np.random.default_rng(seed).normal(size=(n, width))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return out


def check_order(got, k):
    for rows in got.values():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= k
        assert all((-a[2], a[1] is None, a[1] or 0) <= (-b[2], b[1] is None, b[1] or 0) for a, b in zip(rows, rows[1:]))


def test_recall_and_scores(spark, tmp_path):
    rows = [(i, v.tolist()) for i, v in enumerate(gaussian(4000, 1))]
    docs = spark.read.parquet(write(spark, tmp_path, rows) + "/embeddings.parquet")
    done = vectortree.search(docs, F.col("vec_id") % 20 == 0, group_rows=500)
    got, want = found(done.found.select("query_id", "rank", "vec_id", "score")), brute(rows)
    check_order(got, 20)
    assert set(got) == set(want) and all(len(r) == 20 for r in got.values())
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, _, i in want[q][0][:20]}) for q in got)
    assert hits >= 0.9 * 20 * len(got) and done.visits < done.leaves and done.calibrated >= 0.95
    score = {(q, i): -s for q in want for s, _, i in want[q][0]}
    assert all(score[q, i] == s for q in got for _, i, s in got[q])


def test_a_hot_vector_and_exact_ties(spark, tmp_path):
    """A third of the rows share one vector, over several groups: neighbours are the smallest ids among the ties."""
    v = gaussian(1500, 2)
    rows = [(i, (v[0] if i % 3 == 0 else v[i]).tolist()) for i in range(1500)]
    got, want = found(vectortree.query(spark, write(spark, tmp_path, rows))), brute(rows)
    check_order(got, 20)
    for q in (q for q in got if q % 3 == 0):
        assert [(i, s) for _, i, s in got[q]] == [(i, -s) for s, _, i in want[q][0][:20]]
    docs = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    small = found(vectortree.search(docs, F.col("vec_id") % 20 == 0, group_rows=64).found)
    assert all(small[q] == got[q] for q in got if q % 3 == 0)


def test_odd_rows(spark, tmp_path):
    v = gaussian(12, 3, 8)
    odd = [None, [], [0.0] * 8, [None] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8]
    rows = [(20 * i, x) for i, x in enumerate(odd)] + [(200, v[0].tolist()), (200, v[0].tolist()), (None, v[0].tolist()), (None, v[1].tolist())]
    rows += [(201 + i, x.tolist()) for i, x in enumerate(v)] + [(400, (2 * v[3]).tolist())]
    path = write(spark, tmp_path, rows)
    done = vectortree.search(spark.read.parquet(f"{path}/embeddings.parquet"), F.col("vec_id") % 20 == 0).found.collect()
    want = brute(rows)
    by = defaultdict(list)
    for r in sorted(done, key=lambda r: r["rank"]):
        by[r.query_rid].append((-r.score, r.vec_id is None, r.vec_id or 0))
    assert len(by) == 3 and sorted(by.values()) == sorted(w for ws in want.values() for w in ws)
    assert len(vectortree.query(spark, path).collect()) == sum(len(b) for b in by.values())


def test_no_queries_and_empty_tables(spark, tmp_path):
    assert vectortree.query(spark, write(spark, tmp_path / "a", [])).count() == 0
    assert vectortree.query(spark, write(spark, tmp_path / "b", [(1, [1.0, 2.0])])).count() == 0
    assert vectortree.query(spark, write(spark, tmp_path / "c", [(20, [1.0, 2.0])])).count() == 0


def test_traversal_is_best_first():
    x = gaussian(3000, 5, 8).astype(np.float64)
    tree = vectortree.fit(x, 100)
    leaf = tree.place(x)
    tree.rows = np.bincount(leaf, minlength=tree.leaves)
    q = gaussian(1, 6, 8).astype(np.float64)
    order = tree.visit(tree.keys(q)[0].tolist(), tree.leaves, 0)
    assert sorted(order) == np.flatnonzero(tree.rows).tolist() and tree.rows.sum() == 3000
    score = x @ q[0]
    first = set(order[: len(order) // 4])
    assert np.mean([leaf[i] in first for i in np.argsort(-score)[:20]]) >= 0.9
    few = tree.visit(tree.keys(q)[0].tolist(), 1, 200)
    assert tree.rows[few].sum() > 200 and few == order[: len(few)]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_equal_vectors_make_one_leaf(n):
    assert vectortree.fit(np.ones((n, 3)), 4).leaves == 1
