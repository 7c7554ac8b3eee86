"""Per-key recursions over event time as stateful streams.

Rows may arrive out of order inside and across micro-batches. They wait in the
state until the watermark has passed them and are then applied in time order;
the state between batches is the recursion state plus the rows still waiting,
so its size is bounded by the lateness allowance (``eventtime``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.functions.timefn import micros
from pitspark.operators.sequential import (
    A_MAX,
    A_MIN,
    FULL,
    GAMMAS,
    HALT,
    HALVE,
    QUARTER,
    SIZES,
    breaker_step,
    expert_discount,
    initial_alphas,
    step_alphas,
    step_weights,
)
from pitspark.streaming.eventtime import RecursionState, use_rocksdb

class _Recursion:
    """A recursion with a flat double state: ``start()`` and ``step()``."""

    def start(self) -> list[float]:
        raise NotImplementedError

    def step(self, core: list[float], *xs: float) -> tuple[list[float], float | tuple[float, ...]]:
        raise NotImplementedError


@dataclass(frozen=True)
class AdaptiveAlpha(_Recursion):
    """Miscoverage level in force before each observation (1 = missed)."""

    target: float = 0.1
    eta: float = 0.01

    def start(self) -> list[float]:
        n = len(GAMMAS)
        return [*initial_alphas(self.target).tolist(), *([1.0 / n] * n)]

    def step(self, core: list[float], x: float) -> tuple[list[float], float]:
        n = len(GAMMAS)
        a, w = np.asarray(core[:n]), np.asarray(core[n:])
        level = float(np.clip((a * w).sum(), A_MIN, A_MAX))
        a = step_alphas(a, x, self.target)
        w = step_weights(w, expert_discount(a, x, self.target, self.eta))
        return [*a.tolist(), *w.tolist()], level


@dataclass(frozen=True)
class DrawdownBreaker(_Recursion):
    """Size multiplier from an equity path."""

    def start(self) -> list[float]:
        return [1.0, 0.0, 0.0]  # peak, halted, halt count

    def step(self, core: list[float], x: float) -> tuple[list[float], float]:
        peak, halted, count = max(core[0], x), bool(core[1]), int(core[2])
        dd = (x - peak) / max(peak, 1e-9)
        level = FULL
        for limit, name in ((-0.15, HALT), (-0.10, QUARTER), (-0.05, HALVE)):
            if dd <= limit + 1e-9:
                level = name
                break
        state, halted, count = breaker_step(level, halted, count)
        return [peak, float(halted), float(count)], SIZES[state]


@dataclass(frozen=True)
class TrailingStop(_Recursion):
    """1 once a long trade, entered at its first price, hits its hard or trailing
    stop (fixed distances) or its holding limit; then it stays 1."""

    hard: float
    trail: float
    max_bars: int = 390

    def start(self) -> list[float]:
        return [float("nan"), float("nan"), 0.0, 0.0]  # entry, best, bars, closed

    def step(self, core: list[float], x: float) -> tuple[list[float], float]:
        entry, best, bars, closed = core
        if np.isnan(entry):
            return [x, x, 0.0, 0.0], 0.0
        best, bars = max(best, x), bars + 1
        stop = entry - self.hard
        if best > entry:
            stop = max(stop, best - self.trail)
        closed = float(bool(closed) or x < stop or bars >= self.max_bars)
        return [entry, best, bars, closed], closed


@dataclass(frozen=True)
class TwoSidedStop(_Recursion):
    """Stop level and exit flag per bar of a long (side +1) or short (-1) trade.

    Values: price, live range (missing: the one at entry), entry price, range at
    entry, side. The hard stop keeps the entry's range, the trailing stop
    follows the best price with the live range once the trade has been ahead.
    The flag also rises at the holding limit; ``latch`` keeps it up.
    """

    hard: float = 2.0
    trail: float = 1.5
    max_bars: int = 390
    latch: bool = False

    def start(self) -> list[float]:
        return [float("nan"), 0.0, 0.0]  # best, bars, closed

    def step(
        self, core: list[float], price: float, live: float | None, entry: float, entry_range: float, side: float
    ) -> tuple[list[float], tuple[float, float]]:
        best, bars, closed = core
        sign = 1.0 if side > 0 else -1.0
        width = entry_range if live is None or np.isnan(live) else live
        ahead = max(sign * price, sign * entry, sign * (entry if np.isnan(best) else best))
        stop = sign * entry - self.hard * entry_range
        if ahead > sign * entry:
            stop = max(stop, ahead - self.trail * width)
        out = bool(sign * price < stop) or bars + 1 >= self.max_bars or (self.latch and bool(closed))
        return [sign * ahead, bars + 1, float(out)], (sign * stop, float(out))


def run_recursion(
    stream: DataFrame,
    recursion: _Recursion,
    *,
    key: str,
    time: str,
    value: str | Sequence[str],
    out: str | Sequence[str],
    lateness: str,
    initial: DataFrame | None = None,
    idle_seconds: int | None = None,
) -> DataFrame:
    """Apply a recursion per key in event-time order: (key, time, values, out).

    ``time`` must be a timestamp with the session zone set to UTC. A row is
    emitted once the watermark has passed it; a row without a time comes out at
    once with a NULL result. ``initial`` (key, core array<double>) starts keys
    from the state a batch job ended with. ``idle_seconds`` of event time
    without a row forget a key, which then starts anew.
    """
    use_rocksdb(stream.sparkSession)
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    src = stream.select(key, time, micros(F.col(time)).alias("us"), F.array(*[F.col(v).cast("double") for v in values]).alias("x"))
    start = None if initial is None else initial.select(key, "core").groupBy(key)
    fields = [T.StructField(key, stream.schema[key].dataType), T.StructField(time, T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in [*values, *outs]]
    done = (
        src.withWatermark(time, lateness)
        .groupBy(key)
        .transformWithState(
            RecursionState(recursion, key, time, values, outs, idle_seconds), T.StructType(fields), "append", "EventTime", start
        )
    )
    return done.select(key, F.timestamp_micros(time).alias(time), *values, *outs)
