"""Two-state Gaussian chain with transitions: fit by EM for all folds at once, filter without a look ahead.

The forward filter is a product of 2x2 matrices, one for each row: its prefixes
are taken inside blocks and, through :func:`chunked.chunk_scan`, over the block
table. EM takes each block of rows as a sequence of its own: one pass sums the
expected counts of every block by fold, and the new parameters of all folds are
made from these sums (sixteen numbers a fold) on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.operators.chunked import BLOCK, POS, SeriesKey, chunk_scan, over_rows, row_positions
from pitspark.session import materialise

LEAST_VARIANCE = 1e-12


@dataclass(frozen=True)
class Chain:
    """``step[i, j]`` leads from state i to j; ``mean`` and ``var`` by state and feature."""

    start: np.ndarray
    step: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def high(self) -> int:
        """The state with the larger mean of the last feature."""
        return int(self.mean[:, -1].argmax())

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Likelihood of each row in each state, up to a factor for each row."""
        logs = -0.5 * ((x[:, None, :] - self.mean) ** 2 / self.var + np.log(self.var)).sum(axis=2)
        return np.exp(logs - logs.max(axis=1, keepdims=True))

    def matrices(self, x: np.ndarray, first: bool) -> np.ndarray:
        """The unnormalised effect of each row on the state's probabilities; ``first``: the sequence begins here."""
        e = self.emissions(x)
        m = e[:, :, None] * self.step.T
        if first:
            m[0] = (e[0] * self.start)[:, None]
        return m


def _prefixes(m: np.ndarray) -> np.ndarray:
    """m[t] @ ... @ m[0], each scaled, in log(n) vector steps."""
    out, reach = m / m.max(axis=(1, 2), keepdims=True), 1
    while reach < len(out):
        new = out.copy()
        new[reach:] = out[reach:] @ out[:-reach]
        out = new / new.max(axis=(1, 2), keepdims=True)
        reach *= 2
    return out


def _probabilities(w: np.ndarray) -> np.ndarray:
    return w / w.sum(axis=-1, keepdims=True)


def expected(chain: Chain, x: np.ndarray) -> np.ndarray:
    """Expected counts of one sequence: of states (2), their sums (2 x features) and squares, moves (4), first state (2)."""
    alpha = _probabilities(_prefixes(chain.matrices(x, first=True)) @ np.full(2, 0.5))
    e = chain.emissions(x)
    beta = np.ones_like(alpha)
    moves = np.zeros((2, 2))
    if len(x) > 1:
        back = chain.step * e[1:, None, :]
        beta[:-1] = _probabilities(_prefixes(back[::-1])[::-1] @ np.ones(2))
        xi = alpha[:-1, :, None] * back * beta[1:, None, :]
        moves = (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    gamma = _probabilities(alpha * beta)
    return np.concatenate((gamma.sum(axis=0), (gamma.T @ x).ravel(), (gamma.T @ x**2).ravel(), moves.ravel(), gamma[0]))


def maximised(stats: np.ndarray, features: int, old: Chain) -> Chain:
    """The parameters that the expected counts of a fold ask for; a state without rows keeps its own."""
    n, s, q, moves, first = np.split(stats, np.cumsum([2, 2 * features, 2 * features, 4]))
    s, q, moves = s.reshape(2, -1), q.reshape(2, -1), moves.reshape(2, 2)
    held = n > 1e-9
    mean = np.where(held[:, None], s / np.maximum(n, 1e-9)[:, None], old.mean)
    var = np.where(held[:, None], np.maximum(q / np.maximum(n, 1e-9)[:, None] - mean**2, LEAST_VARIANCE), old.var)
    total = moves.sum(axis=1, keepdims=True)
    return Chain(_probabilities(first), np.where(total > 0, moves / np.maximum(total, 1e-300), old.step), mean, var)


def first_chains(train: DataFrame, fold: str, key: SeriesKey, features: Sequence[str]) -> dict:
    """For each fold: states split at the mean of the last feature; their moments, and counted moves (each plus one)."""
    cuts = train.groupBy(fold).agg(F.avg(features[-1]).alias("__cut"))
    high = F.col(features[-1]) > F.col("__cut")
    rows = train.join(F.broadcast(cuts), fold).withColumn("__s", high.cast("int"))  # one row a fold
    series = SeriesKey(key.by if fold in key.by else (*key.by, fold), key.time, key.tie, key.chunk_seconds)
    rows = over_rows(rows, series, lambda d, w: d.withColumn("__l", F.lag("__s").over(w)), lookback=1)
    sums = [F.count("*").alias("n")]
    for s in (0, 1):
        own = F.col("__s") == s
        sums += [F.avg(F.when(own, F.col(f))).alias(f"m{s}{i}") for i, f in enumerate(features)]
        sums += [F.var_pop(F.when(own, F.col(f))).alias(f"v{s}{i}") for i, f in enumerate(features)]
        sums += [F.count_if(own & (F.col("__l") == q)).alias(f"t{q}{s}") for q in (0, 1)]
    out = {}
    for r in rows.groupBy(fold).agg(*sums).collect():
        wide = lambda a: np.array([[r[f"{a}{s}{i}"] if r[f"{a}{s}{i}"] is not None else np.nan for i in range(len(features))] for s in (0, 1)])  # noqa: B023, E731
        mean, var = wide("m"), np.maximum(wide("v"), LEAST_VARIANCE)
        step = _probabilities(np.array([[r[f"t{q}{s}"] + 1.0 for s in (0, 1)] for q in (0, 1)]))
        if not np.isnan(mean).any():
            out[r[fold]] = (r["n"], Chain(np.full(2, 0.5), step, mean, var))
    return out


def fit_chains(rows: DataFrame, fold: str, key: SeriesKey, features: Sequence[str], train: Column, *, turns: int = 10, min_rows: int = 200, block_rows: int = 4096) -> dict[object, Chain]:
    """A chain for each fold with at least ``min_rows`` training rows whose features are all there.

    One job a turn for all folds; ``turns=0`` gives the starting parameters. The
    result is a few numbers for each fold.
    """
    series = SeriesKey(key.by if fold in key.by else (*key.by, fold), key.time, key.tie, key.chunk_seconds)
    known = rows.filter(train)
    for f in features:
        known = known.filter(F.col(f).isNotNull())
    cols = list(dict.fromkeys([fold, *series.by, *series.order, *features]))
    known = materialise(known.select(*cols)) if turns else known.select(*cols)
    chains = {k: c for k, (n, c) in first_chains(known, fold, key, features).items() if n >= min_rows}
    if not turns or not chains:
        return chains
    blocks = row_positions(known, series).withColumn(BLOCK, F.floor((F.col(POS) - 1) / block_rows))
    blocks = blocks.groupBy(*series.by, BLOCK).agg(F.sort_array(F.collect_list(F.struct(POS, *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]))).alias("x"))
    blocks = materialise(blocks.select(F.col(fold).alias("fold"), *[F.col(f"x.x{i}").alias(f"x{i}") for i in range(len(features))]))
    kind, width = rows.schema[fold].dataType.simpleString(), 8 + 4 * len(features)
    for _ in range(turns):

        def pass_over(batches, chains=chains):
            for pdf in batches:
                for fold_id, *xs in pdf.itertuples(index=False):
                    if fold_id in chains:
                        yield pd.DataFrame([[fold_id, *expected(chains[fold_id], np.stack(xs, axis=1))]])

        sums = blocks.mapInPandas(pass_over, f"fold {kind}, " + ", ".join(f"s{i} double" for i in range(width)))
        for r in sums.groupBy("fold").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).collect():
            chains = {**chains, r["fold"]: maximised(np.array(r[1:]), len(features), chains[r["fold"]])}
    return chains


def filtered(rows: DataFrame, fold: str, key: SeriesKey, features: Sequence[str], chains: Mapping[object, Chain], out: str, *, block_rows: int = 50_000, fan: int = 1024) -> DataFrame:
    """Add the probability of the high state given all rows of the series and fold up to each row.

    0.5 for rows with a missing feature, which the chain steps over, and for folds without a chain.
    """
    series = SeriesKey(key.by if fold in key.by else (*key.by, fold), key.time, key.tie, key.chunk_seconds)
    usable = F.coalesce(F.col(fold).isin(list(chains)), F.lit(False)) if chains else F.lit(False)
    for f in features:
        usable = usable & F.col(f).isNotNull()
    cols = rows.columns

    def of(pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[list(features)].to_numpy(dtype=float)
        return _prefixes(chains[pdf[fold].iloc[0]].matrices(x, first=pdf[POS].iloc[0] == 1))

    def walk(state: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.concatenate((state[None], _probabilities(_prefixes(m.reshape(-1, 2, 2)) @ state)))

    def apply(pdf: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        p = _probabilities(of(pdf) @ state)
        return pdf[cols].assign(**{out: p[:, chains[pdf[fold].iloc[0]].high()]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    done = chunk_scan(
        rows.filter(usable), series, summarise=lambda pdf: of(pdf)[-1].ravel(), compose=lambda m: _prefixes(m.reshape(-1, 2, 2))[-1].ravel(), walk=walk, start=[0.5, 0.5],
        apply=apply, out_schema=f"{schema}, `{out}` double", block_rows=block_rows, fan=fan,
    )
    return done.unionByName(rows.filter(~usable).withColumn(out, F.lit(0.5)))
