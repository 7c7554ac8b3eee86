"""Product codes against the plain method."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitspark.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, row string, node int, error string, part string"


def plain(rows):
    """(vec_id, code, error, label_error, sha256) of (vec_id, vector, label) rows by the definition."""
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.floor(1024.0 * np.array([r[1] for r in kept], dtype=np.float32).astype(np.float64)).astype(np.int64)
    parts = np.split(x, 4, axis=1)
    books = [p[:256].copy() for p in parts]

    def nearest(p, book):
        d = ((p[:, None, :] - book[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(4):
        for p, book in zip(parts, books):
            a, _ = nearest(p, book)
            for e in np.unique(a):
                book[e] = p[a == e].sum(0) // (a == e).sum()
    found = [nearest(p, b) for p, b in zip(parts, books)]
    error = sum(d for _, d in found)
    label = defaultdict(int)
    for r, e in zip(kept, error):
        label[r[2]] += int(e)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return Counter((r[0], bytes(f[0][i] for f in found).hex(), int(error[i]), label[r[2]], sha) for i, r in enumerate(kept))


def write(spark, path, rows):
    spark.createDataFrame([(*r, "r", 1, "e", "p") for r in rows], SCHEMA).repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def check(spark, path, rows):
    got = codebooks.query(spark, write(spark, path, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == plain(rows)


def clustered(n, seed=0, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, width))
    v = centres[rng.integers(0, 40, n)] + 0.2 * rng.normal(size=(n, width))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_clustered_rows(spark, tmp_path):
    check(spark, tmp_path, [(i, v.tolist(), i % 7 if i % 5 else None) for i, v in enumerate(clustered(3000))])


def test_a_hot_vector_ties_and_repeated_ids(spark, tmp_path):
    v = clustered(900, 1)
    rows = [(i // 2, v[i if i % 3 else 0].tolist(), 1 if i % 3 else 0) for i in range(900)]
    rng = np.random.default_rng(5)
    rows += [(1000 + i, (rng.integers(-2, 3, 16) / 2.0).tolist(), 2) for i in range(600)]  # a grid: many equal distances
    check(spark, tmp_path, rows)


def test_odd_rows_and_few_rows(spark, tmp_path):
    v = clustered(9, 2)
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 15 + [None], [0.5] * 12, [3000.0] * 16, [-3000.5] * 16]
    rows = [(i, x, None) for i, x in enumerate(odd)] + [(None, v[0].tolist(), 3), (None, v[0].tolist(), 3), (5, v[1].tolist(), None)] + [(100 + i, x.tolist(), 1) for i, x in enumerate(v)]
    check(spark, tmp_path, rows)


def test_an_empty_table(spark, tmp_path):
    assert codebooks.query(spark, write(spark, tmp_path / "none", [])).count() == 0
    assert codebooks.query(spark, write(spark, tmp_path / "nulls", [(1, None, 1)])).count() == 0


def test_too_large_components_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="too large"):
        codebooks.query(spark, write(spark, tmp_path, [(1, [1e30] * 16, 1), (2, [0.0] * 16, 1)]))


def test_bounds_save_comparisons(spark, tmp_path):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(clustered(6000, 3))]
    done = codebooks.compress(spark.read.parquet(write(spark, tmp_path, rows) + "/embeddings.parquet"))
    assert len(done.compared) == 4 and max(done.compared) < 0.4
    assert all(codebooks.LEAST_B <= b <= codebooks.MOST_B for bs in done.listed for b in bs)
    assert len({b for bs in done.listed for b in bs}) > 1


@pytest.mark.parametrize("listed", [1, 2, 5, 12])
def test_reassign_equals_the_whole_codebook(listed):
    rng = np.random.default_rng(listed)
    x, entries = rng.integers(-40, 40, (500, 4)), rng.integers(-40, 40, (30, 4))
    bounds = codebooks.Bounds(*codebooks._whole(x, entries, listed)[:2])
    for turn in range(8):
        after = entries + rng.integers(-6, 7, entries.shape) * (rng.random((30, 1)) < 0.5)
        moved = np.sqrt(((after - entries) ** 2).sum(1)) * (1 + 1e-5)
        entries = after
        bounds, best, _ = codebooks.reassign(x, entries, moved, bounds, max(1, listed + turn % 3 - 1))
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (bounds.near[:, 0] == d.argmin(1)).all() and (best == d.min(1)).all()
