"""Path-dependent state over long series, parallel over bounded blocks.

Both recursions below have a compact composite per block, so they run as
:func:`chunked.chunk_scan`: blocks are summarised in parallel, the block table is
scanned as a tree, and blocks are replayed in parallel from their entering
state. The per-row helpers are also what the streaming operators use.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.operators.chunked import Running, SeriesKey, chunk_scan, running

# --- drawdown breaker -----------------------------------------------------

FULL, HALVE, QUARTER, HALT = 0, 1, 2, 3
SIZES = (1.0, 0.5, 0.25, 0.0)
RECOVERY_ROWS = 65


def breaker_level(drawdown: Column) -> Column:
    """Level a drawdown asks for; thresholds are inclusive."""
    return (
        F.when(drawdown <= -0.15 + 1e-9, HALT)
        .when(drawdown <= -0.10 + 1e-9, QUARTER)
        .when(drawdown <= -0.05 + 1e-9, HALVE)
        .otherwise(FULL)
    )


def breaker_step(level: int, halted: bool, count: int) -> tuple[int, bool, int]:
    """One row: (state, halted, halt count) after a wanted level. A halt of
    ``RECOVERY_ROWS`` rows in total is followed by one full row."""
    if halted and count >= RECOVERY_ROWS:
        level = FULL
    if level == HALT:
        return HALT, True, count + 1
    return level, False, 0 if level == FULL else count


_MAX = RECOVERY_ROWS + 2
_CYCLE = RECOVERY_ROWS + 1


def _runs(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level and length of each run of equal levels."""
    edge = np.flatnonzero(np.concatenate(([True], levels[1:] != levels[:-1])))
    return levels[edge], np.diff(np.append(edge, len(levels)))


def _behind(level: int, n: int, halted: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`breaker_step` after a run of ``n`` rows that want ``level``, for many states at once."""
    if level == FULL:
        return np.zeros_like(halted), np.zeros_like(count)
    if level != HALT:
        return np.zeros_like(halted), np.where(halted & (count >= RECOVERY_ROWS), 0, count)
    until = _until(halted, count)
    rest = (n - until - 1) % _CYCLE
    return np.where(n <= until, True, rest > 0), np.where(n <= until, count + n, rest)


def _until(halted, count):
    """Halting rows before the first full one of a run that wants to halt."""
    return np.maximum(np.where(halted, 0, 1), RECOVERY_ROWS - count)


def drawdown_breaker(df: DataFrame, key: SeriesKey, *, equity: str, out: str = "size_multiplier", block_rows: int = 50_000, fan: int = 1024) -> DataFrame:
    """Size multiplier per row from the equity path (key, time, equity, level, out).

    A state is (halted, count), as one number 2 * count + halted. A block acts as
    the table of what becomes of each state, made run by run of equal levels.
    """
    by = list(key.by)
    top = running(df.select(*by, *key.order, equity), key, [Running("__peak", "max", F.col(equity))])
    peak = F.greatest(F.col("__peak"), F.lit(1.0))
    rows = top.withColumn("level", breaker_level((F.col(equity) - peak) / F.greatest(peak, F.lit(1e-9)))).drop("__peak")

    def summarise(pdf: pd.DataFrame) -> np.ndarray:
        state = np.arange(2 * _MAX)
        halted, count = state % 2 == 1, state // 2
        for level, n in zip(*_runs(pdf["level"].to_numpy())):
            halted, count = _behind(level, n, halted, count)
        return 2 * np.minimum(count, _MAX - 1) + halted

    def compose(tables: np.ndarray) -> np.ndarray:
        return walk_all(np.arange(2 * _MAX, dtype=float), tables)

    def walk_all(state: np.ndarray, tables: np.ndarray) -> np.ndarray:
        for t in tables:
            state = t[state.astype(int)]
        return state

    def walk(state: np.ndarray, tables: np.ndarray) -> np.ndarray:
        states = [state]
        for t in tables:
            states.append(t[states[-1].astype(int)])
        return np.stack(states)

    cols = [*by, *key.order, equity, "level"]

    def apply(pdf: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        count, halted = np.array([int(state[0]) // 2]), np.array([int(state[0]) % 2 == 1])
        sizes, at = np.empty(len(pdf)), 0
        for level, n in zip(*_runs(pdf["level"].to_numpy())):
            sizes[at : at + n] = SIZES[level]
            if level == HALT:
                sizes[at + int(_until(halted, count)[0]) : at + n : _CYCLE] = SIZES[FULL]
            elif halted[0] and count[0] >= RECOVERY_ROWS:
                sizes[at] = SIZES[FULL]
            halted, count = _behind(level, n, halted, count)
            at += n
        return pdf[cols].assign(**{out: sizes})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cols).schema)
    return chunk_scan(
        rows, key, summarise=summarise, compose=compose, walk=walk, start=[0.0], apply=apply, out_schema=f"{schema}, `{out}` double", block_rows=block_rows, fan=fan
    )


# --- adaptive miscoverage level -------------------------------------------

GAMMAS = np.array([0.001, 0.005, 0.01, 0.05, 0.1])
A_MIN, A_MAX, EPS = 0.001, 0.5, 1e-12


def initial_alphas(target: float = 0.1) -> np.ndarray:
    return np.clip(target + np.linspace(-0.02, 0.02, len(GAMMAS)), A_MIN, A_MAX)


def step_alphas(alphas: np.ndarray, missed: float, target: float = 0.1) -> np.ndarray:
    return np.clip(alphas + GAMMAS * (target - missed), A_MIN, A_MAX)


def expert_discount(alphas: np.ndarray, missed: float, target: float = 0.1, eta: float = 0.01) -> np.ndarray:
    """exp(-eta * pinball loss) of each expert."""
    r = missed - alphas
    return np.exp(-eta * np.where(r >= 0, target * r, (target - 1.0) * r))


def step_weights(weights: np.ndarray, discount: np.ndarray) -> np.ndarray:
    w = (weights + EPS) * discount
    return w / w.sum()


def _prefixes(items: np.ndarray, join) -> np.ndarray:
    """Inclusive prefixes of an associative ``join(earlier, later)`` over the first axis, in log(n) vector steps."""
    out, reach = items.copy(), 1
    while reach < len(out):
        out[reach:] = join(out[:-reach], out[reach:])
        reach *= 2
    return out


def _join_clamps(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """(c, lo, hi) means x -> clip(x + c, lo, hi)."""
    c, lo, hi = then[..., 0, :], then[..., 1, :], then[..., 2, :]
    return np.stack((first[..., 0, :] + c, np.clip(first[..., 1, :] + c, lo, hi), np.clip(first[..., 2, :] + c, lo, hi)), axis=-2)


def _join_weights(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    m = then @ first
    return m / m.max(axis=(-2, -1), keepdims=True)


def _discounts(alphas: np.ndarray, missed: np.ndarray, target: float, eta: float) -> np.ndarray:
    """:func:`expert_discount` of many rows."""
    r = missed[:, None] - alphas
    return np.exp(-eta * np.where(r >= 0, target * r, (target - 1.0) * r))


def adaptive_alpha(df: DataFrame, key: SeriesKey, *, missed: str, target: float = 0.1, eta: float = 0.01, block_rows: int = 50_000, fan: int = 1024) -> DataFrame:
    """Aggregated miscoverage level in force before each row (``alpha``) and
    after it (``alpha_next``).

    Expert levels are clamped sums: a row and a block act as x -> clip(x + c, lo, hi).
    Expert weights, unnormalised, change linearly: they act as a matrix. Both
    compose, so both are scans over blocks, levels first, and prefixes inside a
    block.
    """
    by = list(key.by)
    n = len(GAMMAS)
    base = df.select(*by, *key.order, F.col(missed).cast("double").alias("missed"))
    first = [*by, *key.order, "missed"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)

    def clamps(pdf: pd.DataFrame) -> np.ndarray:
        c = GAMMAS * (target - pdf["missed"].to_numpy()[:, None])
        return _prefixes(np.stack((c, np.full_like(c, A_MIN), np.full_like(c, A_MAX)), axis=1), _join_clamps)

    def after(state: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
        return np.concatenate((state[None], np.clip(state + prefixes[:, 0], prefixes[:, 1], prefixes[:, 2])))

    def apply_levels(pdf: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        a = after(state, clamps(pdf))
        return pdf[first].assign(before=list(a[:-1]), after=list(a[1:]))

    shaped = lambda comps: _prefixes(comps.reshape(-1, 3, n), _join_clamps)
    levels = chunk_scan(
        base, key, summarise=lambda pdf: clamps(pdf)[-1].ravel(), compose=lambda comps: shaped(comps)[-1].ravel(), walk=lambda state, comps: after(state, shaped(comps)),
        start=initial_alphas(target), apply=apply_levels, out_schema=f"{schema}, before array<double>, after array<double>", block_rows=block_rows, fan=fan,
    )

    def matrices(pdf: pd.DataFrame) -> np.ndarray:
        m = _discounts(np.stack(pdf["after"]), pdf["missed"].to_numpy(), target, eta)[:, :, None] * (np.eye(n) + EPS)
        return _prefixes(m, _join_weights)

    def weights(state: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
        w = prefixes @ state
        return np.concatenate((state[None], w / w.sum(axis=1, keepdims=True)))

    def apply_weights(pdf: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        w = weights(state, matrices(pdf))
        used = np.clip((w[:-1] * np.stack(pdf["before"])).sum(axis=1), A_MIN, A_MAX)
        nxt = np.clip((w[1:] * np.stack(pdf["after"])).sum(axis=1), A_MIN, A_MAX)
        return pdf[first].assign(alpha=used, alpha_next=nxt)

    square = lambda comps: _prefixes(comps.reshape(-1, n, n), _join_weights)
    return chunk_scan(
        levels, key, summarise=lambda pdf: matrices(pdf)[-1].ravel(), compose=lambda comps: square(comps)[-1].ravel(), walk=lambda state, comps: weights(state, square(comps)),
        start=[1.0 / n] * n, apply=apply_weights, out_schema=f"{schema}, alpha double, alpha_next double", block_rows=block_rows, fan=fan,
    )
