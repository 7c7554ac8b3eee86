"""Gradient boosting of multi-class trees from histograms.

Features are cut into bins once; rows travel as blocks of bin numbers. A round
grows one tree for each class, level by level: a pass sums gradients and second
derivatives by (class, node, feature, bin) in every task, Spark adds them up, and
the driver, which holds classes x nodes x features x bins sums whatever the
number of rows, picks the splits. Margins are written with the blocks every
``keep_every`` rounds, so a pass walks few trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.session import materialise

BLOCK_ROWS = 16_384


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: node i has children 2i+1 (bin <= cut) and 2i+2. ``feature`` -1: the value counts."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def node(self, bins: np.ndarray, levels: int) -> np.ndarray:
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[at]))
        return at


@dataclass
class Boosted:
    """``edges``: inner bin edges by feature; ``rounds``: one tree for each class; ``losses``: the mean training loss before each round."""

    edges: list[np.ndarray]
    depth: int
    classes: int
    rounds: list[list[Tree]]
    losses: list[float]

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers; a missing value is bin 0, below all others."""
        out = [np.where(np.isnan(x[:, i]), 0, np.searchsorted(e, x[:, i], side="left") + 1) for i, e in enumerate(self.edges)]
        return np.stack(out, axis=1).astype(np.uint8)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(margins(self.binned(x), np.zeros((len(x), self.classes)), self.rounds, self.depth))


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def margins(bins: np.ndarray, start: np.ndarray, rounds: list[list[Tree]], depth: int) -> np.ndarray:
    out = start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += tree.value[tree.node(bins, depth)]
    return out


def sums(bins: np.ndarray, y: np.ndarray, p: np.ndarray, growing: list[Tree], level: int, n_bins: int) -> np.ndarray:
    """Gradient and second derivative by (class, node of the level, feature, bin)."""
    features, first = bins.shape[1], 2**level - 1
    out = np.zeros((2, len(growing), 2**level, features, n_bins))
    for k, tree in enumerate(growing):
        g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])
        node = tree.node(bins, level) - first
        own = node >= 0  # the others stopped above
        for f in range(features):
            slot = node[own] * n_bins + bins[own, f]
            for side, v in enumerate((g, h)):
                out[side, k, :, f] = np.bincount(slot, weights=v[own], minlength=2**level * n_bins).reshape(2**level, n_bins)
    return out


def grow(tree: Tree, found: np.ndarray, level: int, depth: int, rate: float, shrink: float, least: float) -> Tree:
    """The tree with the nodes of ``level`` split where that gains, by sums (side, node, feature, bin); ties to the
    first feature and bin. Nodes get their value from their sums."""
    feature, cut, value = tree.feature.copy(), tree.cut.copy(), tree.value.copy()
    score = lambda g, h: g**2 / (h + shrink)
    for i in range(2**level):
        g, h = found[:, i]
        if not h.any():
            continue
        node, total, weight = 2**level - 1 + i, g[0].sum(), h[0].sum()
        value[node] = -rate * total / (weight + shrink)
        if level == depth:
            continue
        gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
        gain = score(gl, hl) + score(total - gl, weight - hl) - score(total, weight)
        gain = np.where((hl >= least) & (weight - hl >= least), gain, 0.0)
        best = int(gain.argmax())
        if gain.flat[best] > 1e-12:
            feature[node], cut[node] = divmod(best, gain.shape[1])
    return Tree(feature, cut, value)


def fit(
    rows: DataFrame, features: list[str], label: Column, *, classes: int = 3, rounds: int = 100, depth: int = 6, rate: float = 0.05, bins: int = 32, shrink: float = 1.0, least: float = 1.0,
    keep_every: int = 10, edges: list[np.ndarray] | None = None,
) -> Boosted:
    """Boosted trees for labels 0 .. classes-1 of all ``rows`` (one pass for each level of a round)."""
    if edges is None:
        shares = [i / bins for i in range(1, bins)]
        cuts = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
        edges = [np.unique(np.array(c if c is not None else [0.0])) for c in cuts]
    model = Boosted(edges, depth, classes, [], [])
    n_bins = max(len(e) for e in edges) + 2

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[at : at + BLOCK_ROWS]
                b = model.binned(part.iloc[:, 1:].to_numpy(dtype=float))
                yield pd.DataFrame([{"y": part.iloc[:, 0].to_numpy(np.uint8).tobytes(), "bins": b.tobytes(), "m": np.zeros((len(b), classes)).tobytes()}])

    def read(y: bytes, b: bytes, m: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(y, np.uint8), np.frombuffer(b, np.uint8).reshape(-1, len(features)), np.frombuffer(m).reshape(-1, classes)

    block = "y binary, bins binary, m binary"
    table = materialise(rows.select(label.cast("int").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).mapInPandas(pack, block))
    held = 0  # rounds that the written margins know
    empty = Tree(np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1, dtype=np.int64), np.zeros(2 ** (depth + 1) - 1))
    for turn in range(rounds):
        if turn - held == keep_every:
            new = model.rounds[held:]

            def rewrite(batches: Iterator[pd.DataFrame], new=new) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    for row in pdf.itertuples(index=False):
                        _, b, m = read(*row)
                        yield pd.DataFrame([{"y": row.y, "bins": row.bins, "m": margins(b, m, new, depth).tobytes()}])

            table, held = materialise(table.mapInPandas(rewrite, block)), turn
        trees = [empty] * classes
        for level in range(depth + 1):
            new = model.rounds[held:]

            def gather(batches: Iterator[pd.DataFrame], new=new, trees=trees, level=level) -> Iterator[pd.DataFrame]:
                total, loss, n = 0.0, 0.0, 0
                for pdf in batches:
                    for row in pdf.itertuples(index=False):
                        y, b, m = read(*row)
                        p = softmax(margins(b, m, new, depth))
                        loss, n = loss - np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum(), n + len(y)
                        total = total + sums(b, y, p, trees, level, n_bins)
                if n:
                    g, h = total.reshape(2, -1)
                    slot = np.flatnonzero(h)
                    yield pd.DataFrame({"slot": np.append(slot, -1), "g": np.append(g[slot], loss), "h": np.append(h[slot], n)})

            found = np.zeros((2, classes * 2**level * len(features) * n_bins))
            for r in table.mapInPandas(gather, "slot long, g double, h double").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                if r.slot >= 0:
                    found[:, r.slot] = r.g, r.h
                elif level == 0:
                    model.losses.append(r.g / r.h)
            found = found.reshape(2, classes, 2**level, len(features), n_bins)
            trees = [grow(t, found[:, k], level, depth, rate, shrink, least) for k, t in enumerate(trees)]
            if not any((t.feature[2**level - 1 : 2 ** (level + 1) - 1] >= 0).any() for t in trees):
                break
        model.rounds.append(trees)
    return model


def with_class(rows: DataFrame, features: list[str], model: Boosted, out: str) -> DataFrame:
    """Add the most likely class (the first of equals) as a double."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: model.probabilities(pdf[features].to_numpy(dtype=float)).argmax(axis=1).astype(float)})

    return rows.mapInPandas(run, schema)
