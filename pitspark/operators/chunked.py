"""Ordered computations over long series without one task per series.

A plain ``Window.partitionBy(series)`` puts a whole series into one task; with
one dominant series that task holds most of the table. Every operator here
cuts a series into *chunks*: a chunk is any expression that does not decrease
along the row order (a time bucket for most tables). Per-chunk facts go
through a window over the chunk table, which has one row per chunk, and come
back by an equi join on (series, chunk); the rows themselves are only ever
partitioned by (series, chunk).

Null is a series key like any other, as in GROUP BY. Rows without a time stand
before all others of their series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pitspark.functions.timefn import micros, time_chunk

CHUNK = "__chunk"
BLOCK = "__block"
POS = "__pos"
PART = "__part"
AT = "__cell"
NO_TIME = -(1 << 62)

Order = Sequence[Column | str]


@dataclass(frozen=True)
class SeriesKey:
    """How a table is split into series and how each series is ordered.

    ``time`` leads the order, ``tie`` makes it unique; ``chunk_seconds`` is the
    width of a chunk, to be chosen so that one series has at most some hundred
    thousand rows per chunk.
    """

    by: tuple[str, ...]
    time: str
    tie: tuple[str, ...] = ()
    chunk_seconds: int = 7 * 86_400

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.tie)

    def chunk(self) -> Column:
        return time_chunk(F.col(self.time), self.chunk_seconds)


def _with_chunk(df: DataFrame, key: SeriesKey, chunk: Column | None) -> DataFrame:
    """Add the partition: series keys and chunk as one struct. It is never null, and its null fields are equal in a join,
    so a null series key keeps its rows and both branches share a shuffle."""
    c = F.coalesce(key.chunk(), F.lit(NO_TIME)) if chunk is None else chunk
    # a partition that an earlier call left in place is reused with its shuffle
    return df if PART in df.columns else df.withColumn(PART, F.struct(*key.by, c.alias(CHUNK)))


def shared_shuffle(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """Partition rows by keys for several consumers of the same rows.

    Two branches of a plan that read different columns of a shuffle get two
    shuffles, and everything below them runs twice; nested two-level operators
    would double the work at every level. Returned with the shuffled table is a
    zero that depends on all its columns: the branch that only needs totals
    adds it, both branches then read the same columns and Spark reuses the one
    exchange. The window and the aggregate above need no further shuffle.
    """
    parts = df.repartition(*keys)
    return parts, F.xxhash64(*parts.columns).bitwiseAND(F.lit(0).cast("long"))


def row_positions(df: DataFrame, key: SeriesKey, pos: str = POS, chunk: Column | None = None) -> DataFrame:
    """Add the 1-based row number inside each series (two-level: chunk sizes are
    summed over the chunk table, rows are numbered inside their chunk)."""
    cut, zero = shared_shuffle(_with_chunk(df, key, chunk), [PART])
    sizes = cut.groupBy(PART).agg(F.sum(zero + 1).alias("__n"))
    series = [F.col(f"{PART}.{k}") for k in key.by]
    before = Window.partitionBy(*series).orderBy(f"{PART}.{CHUNK}").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(PART).orderBy(*key.order)
    numbered = cut.withColumn("__rn", F.row_number().over(inside)).join(offsets, PART)
    return numbered.select(*df.columns, (F.col("__rn").cast("long") + F.col("__off")).alias(pos))


def over_rows(
    df: DataFrame,
    key: SeriesKey,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    lookback: int,
    lookahead: int = 0,
    block_rows: int | None = None,
    keep_pos: str | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Run bounded-frame window expressions block by block.

    Rows are numbered, cut into blocks of equal row count, and the last
    ``lookback`` rows of each block are copied into the next one (the first
    ``lookahead`` rows into the previous one). ``compute(df, w)`` adds columns
    using frames of the window ``w``; copies are dropped afterwards. Results
    equal a window over the whole series as long as no value reaches further
    than the declared distance. All frames share one sort.
    """
    size = block_rows or max(4096, 4 * (lookback + lookahead))
    if size < max(lookback, lookahead):
        raise ValueError("block_rows must be at least as large as the halo")
    by = list(key.by)
    numbered = row_positions(df, key, chunk=chunk)
    home = F.floor((F.col(POS) - 1) / F.lit(size)).cast("long")
    at = F.pmod(F.col(POS) - 1, F.lit(size))
    targets = [home]
    if lookback:
        targets.append(F.when(at >= size - lookback, home + 1))
    if lookahead:
        targets.append(F.when((at < lookahead) & (home > 0), home - 1))
    if len(targets) == 1:
        block = home
    else:
        block = F.explode(F.array_compact(F.array(*targets)))
    spread = numbered.select("*", home.alias("__home"), block.alias(BLOCK)).withColumn(AT, F.struct(*by, BLOCK)).repartition(AT)
    w = Window.partitionBy(AT).orderBy(POS)
    out = compute(spread, w).filter(F.col(BLOCK) == F.col("__home")).drop(BLOCK, AT, "__home")
    return out.withColumnRenamed(POS, keep_pos) if keep_pos else out.drop(POS)


def over_time(
    df: DataFrame,
    key: SeriesKey,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    seconds: int,
) -> DataFrame:
    """Like :func:`over_rows` for RANGE frames reaching ``seconds`` back: time
    chunks overlap by that much. ``compute`` gets a window ordered by time in
    microseconds, so frame bounds are plain numbers. Rows without a time are
    a frame of their own. One shuffle."""
    if seconds > key.chunk_seconds:
        raise ValueError("chunk_seconds must be at least the range of the frame")
    width = key.chunk_seconds * 1_000_000
    us = micros(F.col(key.time))
    cut = df.withColumn("__us", us).withColumn("__home", F.coalesce(key.chunk(), F.lit(NO_TIME)))
    late = F.pmod(F.col("__us"), F.lit(width)) >= width - seconds * 1_000_000
    spread = cut.withColumn(
        CHUNK, F.explode(F.array_compact(F.array(F.col("__home"), F.when(late, F.col("__home") + 1))))
    )
    w = Window.partitionBy(*key.by, CHUNK).orderBy("__us")
    out = compute(spread, w).filter(F.col(CHUNK) == F.col("__home"))
    return out.drop(CHUNK, "__home", "__us")


def guarded(agg: Column, value: Column, frame: WindowSpec, min_periods: int) -> Column:
    """A windowed aggregate that is NULL until the frame holds ``min_periods``
    non-null values."""
    return F.when(F.count(value).over(frame) >= min_periods, agg.over(frame))


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    """Frame of the current row and the ``rows - 1`` before it."""
    return w.rowsBetween(-(rows - 1), 0)


def ewm_lookback(alpha: float, floor: float = 1e-18) -> int:
    """Rows after which an exponential weight drops below ``floor``."""
    return max(1, math.ceil(math.log(floor) / math.log(1.0 - alpha)))


def ewm_block(alpha: float, lookback: int = 1) -> int:
    """Largest block the scaled prefix sum of :func:`with_ewm` may span without
    leaving the double range (weights stay above 1e-290)."""
    limit = int(290 * math.log(10) / -math.log(1.0 - alpha)) - lookback
    return max(lookback, min(max(4096, 4 * lookback), limit))


@dataclass(frozen=True)
class Ewm:
    """One recursive exponential average of ``value``; rows before the series
    position ``first_pos`` don't count."""

    value: Column
    alpha: float
    first_pos: int = 1


def with_ewm(d: DataFrame, w: WindowSpec, specs: dict[str, Ewm], *, fan: int = 1024) -> DataFrame:
    """Add recursive exponential averages, seeded with the first value; for use inside :func:`over_rows`.

    Each value moves the average by y = c y' + (1-c) x. Without gaps c is
    1 - alpha. A gap carries the average forward while the weight of the past
    goes on falling: g rows after the last value, c = d^g / (d^g + alpha) with
    d = 1 - alpha. So a block acts on the average that enters it as an affine
    map, once the distance to the value before it is known. Blocks are
    summarised where they lie, the maps of a series are composed over its block
    table (:func:`_entering`), and every row then starts from the average that
    enters its block: no halo, and gaps of any length. Inside the block the
    recursion is a prefix sum, scaled by the running product of c.

    Copied rows have no average, but for the one just before the block, so that
    a lag of one row may be taken; longer lags need a second ``over_rows``.
    """
    kept = list(d.columns)
    d = d.withColumn("__own", F.col(BLOCK) == F.col("__home"))
    d = d.withColumns({f"__x_{o}": F.when(F.col("__own") & (F.col(POS) >= s.first_pos), s.value).cast("double") for o, s in specs.items()})
    over = f"OVER (PARTITION BY {AT} ORDER BY {POS} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    upto, before = f"{over} CURRENT ROW)", f"{over} 1 PRECEDING)"

    def added(*template: str) -> None:
        nonlocal d
        new = [t.format(o=o, p=POS, alpha=_sql(s.alpha), c=_past_weight(s.alpha, f"{POS} - `__p_{o}`"), upto=upto, before=before) for o, s in specs.items() for t in template]
        d = d.selectExpr("*", *new)

    added("last(if(`__x_{o}` IS NOT NULL, {p}, NULL), true) {before} AS `__p_{o}`")
    added("if(`__x_{o}` IS NOT NULL AND `__p_{o}` IS NOT NULL, {c}, NULL) AS `__c_{o}`")
    added("sum(coalesce(-ln(`__c_{o}`), 0D)) {upto} AS `__l_{o}`")
    added("(1 - `__c_{o}`) * `__x_{o}` * exp(`__l_{o}`) AS `__t_{o}`")
    summary = """named_struct('fp', min(if(`__x_{o}` IS NOT NULL, {p}, NULL)), 'f', min_by(`__x_{o}`, if(`__x_{o}` IS NOT NULL, {p}, NULL)),
        'lp', max(if(`__x_{o}` IS NOT NULL, {p}, NULL)), 'a', exp(-max(`__l_{o}`)), 'b', exp(-max(`__l_{o}`)) * coalesce(sum(`__t_{o}`), 0D)) AS `{o}`"""
    zero = "max(xxhash64({}) & 0L) AS __z".format(", ".join(f"`{c}`" for c in kept))  # see shared_shuffle
    parts = d.groupBy(AT).agg(F.expr(zero), *[F.expr(summary.format(o=o, p=POS)) for o in specs]).filter("__z = 0").drop("__z")
    added("sum(`__t_{o}`) {upto} AS `__s_{o}`", "first(`__x_{o}`, true) {upto} AS `__f_{o}`", "first(if(`__x_{o}` IS NOT NULL, {p}, NULL), true) {upto} AS `__q_{o}`")
    d = d.selectExpr("*", f"lead(__own) OVER (PARTITION BY {AT} ORDER BY {POS}) AS __next")
    d = d.join(_entering(parts, {o: s.alpha for o, s in specs.items()}, fan), AT)

    def average(o: str, alpha: float) -> str:
        start = _joined(f"__in.`{o}`", f"`__f_{o}`", f"`__q_{o}`", alpha)
        here = f"if(`__q_{o}` IS NULL, __in.`{o}`.y, exp(-`__l_{o}`) * ({start} + coalesce(`__s_{o}`, 0D)))"
        return f"CASE WHEN __own THEN {here} WHEN __next THEN __in.`{o}`.y END AS `{o}`"

    return d.selectExpr(*[f"`{c}`" for c in kept], *[average(o, s.alpha) for o, s in specs.items()])


def _sql(x: float) -> str:
    return f"{x!r}D"


def _past_weight(alpha: float, gap: str) -> str:
    past = f"power({_sql(1.0 - alpha)}, {gap})"
    return f"({past} / ({past} + {_sql(alpha)}))"


def _joined(state: str, x: str, pos: str, alpha: float) -> str:
    """The average at a value x at ``pos`` behind a state (y: average, p: position of its last value)."""
    c = _past_weight(alpha, f"{pos} - {state}.p")
    return f"if({state}.y IS NULL, {x}, {c} * {state}.y + (1 - {c}) * {x})"


def _entering(parts: DataFrame, alphas: dict[str, float], fan: int) -> DataFrame:
    """(AT, __in): the state (y: average, p: position of its last value) that enters each block, for every average.

    A scan in two levels over the block table: the maps of ``fan`` blocks are composed, the composites of a series
    are walked, and each group of ``fan`` maps is walked again from the state that enters it.
    """
    none = "named_struct(" + ", ".join(f"'{o}', named_struct('y', CAST(NULL AS DOUBLE), 'p', CAST(NULL AS BIGINT))" for o in alphas) + ")"
    same = "named_struct(" + ", ".join(
        f"'{o}', named_struct('fp', CAST(NULL AS BIGINT), 'f', CAST(NULL AS DOUBLE), 'lp', CAST(NULL AS BIGINT), 'a', 1D, 'b', 0D)" for o in alphas
    ) + ")"

    def step(state: str, m: str) -> str:
        """The state behind a block."""
        one = (
            f"'{o}', named_struct('y', if({m}.`{o}`.fp IS NULL, {state}.`{o}`.y, {m}.`{o}`.a * {_joined(f'{state}.`{o}`', f'{m}.`{o}`.f', f'{m}.`{o}`.fp', a)} + {m}.`{o}`.b),"
            f" 'p', coalesce({m}.`{o}`.lp, {state}.`{o}`.p))"
            for o, a in alphas.items()
        )
        return f"named_struct({', '.join(one)})"

    def compose(m: str, n: str) -> str:
        """The map of a block and the one behind it."""
        parts = []
        for o, alpha in alphas.items():
            one, two = f"{m}.`{o}`", f"{n}.`{o}`"
            c = _past_weight(alpha, f"{two}.fp - {one}.lp")
            both = f"named_struct('fp', {one}.fp, 'f', {one}.f, 'lp', {two}.lp, 'a', {two}.a * {c} * {one}.a, 'b', {two}.a * ({c} * {one}.b + (1 - {c}) * {two}.f) + {two}.b)"
            parts.append(f"'{o}', CASE WHEN {two}.fp IS NULL THEN {one} WHEN {one}.fp IS NULL THEN {two} ELSE {both} END")
        return f"named_struct({', '.join(parts)})"

    block = f"{AT}.{BLOCK}"
    series = [f.name for f in parts.schema[AT].dataType if f.name != BLOCK]
    key = "struct({})".format(", ".join(f"{AT}.`{c}`" for c in series)) if series else "struct(0)"
    maps = "struct({})".format(", ".join(f"`{o}`" for o in alphas))
    some = parts.selectExpr(f"{key} AS __s", f"{block} div {fan} AS __u", f"named_struct('k', {block}, 'm', {maps}, 'at', {AT}) AS e")
    some = some.groupBy("__s", "__u").agg(F.expr("sort_array(collect_list(e)) AS ms"))
    some = some.selectExpr("*", f"aggregate(ms, {same}, (acc, e) -> {compose('acc', 'e.m')}) AS total")
    earlier = "collect_list(total) OVER (PARTITION BY __s ORDER BY __u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    some = some.selectExpr("ms", f"{earlier} AS totals").selectExpr("ms", f"aggregate(totals, {none}, (acc, m) -> {step('acc', 'm')}) AS start")
    out = f"named_struct('at', e.at, 'state', acc.state)"
    nothing = f"slice(array(named_struct('at', ms[0].at, 'state', {none})), 1, 0)"
    walk = f"aggregate(ms, named_struct('state', start, 'out', {nothing}), (acc, e) -> named_struct('state', {step('acc.state', 'e.m')}, 'out', concat(acc.out, array({out}))), acc -> acc.out)"
    return some.selectExpr(f"inline({walk}) AS ({AT}, __in)")


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` is sum, max, min, count or last."""

    out: str
    kind: str
    value: Column


def running(
    df: DataFrame,
    key: SeriesKey,
    specs: Sequence[Running],
    chunk: Column | None = None,
    keep_chunk: bool = False,
) -> DataFrame:
    """Unbounded prefix aggregates (inclusive of the current row) per series:
    prefix inside the chunk combined with the totals of all earlier chunks.
    ``keep_chunk`` leaves the partition column in place so that a following call
    reuses the partitioning."""
    cut = _with_chunk(df, key, chunk).withColumns({f"__v_{s.out}": s.value for s in specs})
    cut, zero = shared_shuffle(cut, [PART])
    order = F.struct(*[F.col(c) for c in key.order])

    def total(s: Running) -> Column:
        v = F.col(f"__v_{s.out}")
        if s.kind == "last":
            return F.max_by(v, F.when(v.isNotNull(), order))
        return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[s.kind](v)

    totals = cut.groupBy(PART).agg(
        F.max(zero).alias("__z"), *[total(s).alias(f"__t_{s.out}") for s in specs]
    )
    totals = totals.filter(F.col("__z") == 0)
    series = [F.col(f"{PART}.{k}") for k in key.by]
    before = Window.partitionBy(*series).orderBy(f"{PART}.{CHUNK}").rowsBetween(Window.unboundedPreceding, -1)

    def carried(s: Running) -> Column:
        t = F.col(f"__t_{s.out}")
        if s.kind == "last":
            return F.last(t, ignorenulls=True).over(before)
        fold = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[s.kind]
        return fold(t).over(before)

    carry = totals.select(PART, *[carried(s).alias(f"__c_{s.out}") for s in specs])
    upto = Window.partitionBy(PART).orderBy(*key.order).rowsBetween(Window.unboundedPreceding, 0)

    def local(s: Running) -> Column:
        v = F.col(f"__v_{s.out}")
        if s.kind == "last":
            return F.last(v, ignorenulls=True).over(upto)
        return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[s.kind](v).over(upto)

    def merged(s: Running) -> Column:
        here, c = F.col(f"__l_{s.out}"), F.col(f"__c_{s.out}")
        if s.kind in ("sum", "count"):
            return F.coalesce(here, F.lit(0)) + F.coalesce(c, F.lit(0))
        if s.kind == "last":
            return F.coalesce(here, c)
        return (F.greatest if s.kind == "max" else F.least)(here, c)

    out = cut.withColumns({f"__l_{s.out}": local(s) for s in specs}).join(carry, PART)
    out = out.withColumns({s.out: merged(s) for s in specs})
    helper = [f"__{p}_{s.out}" for s in specs for p in "vlc"]
    return out.drop(*helper, *([] if keep_chunk else [PART]))


def chunk_scan(
    df: DataFrame,
    key: SeriesKey,
    *,
    summarise: Callable,
    compose: Callable,
    walk: Callable,
    start: Sequence[float],
    apply: Callable,
    out_schema: str,
    block_rows: int = 50_000,
    fan: int = 1024,
) -> DataFrame:
    """Exact scan for path-dependent state, parallel over blocks.

    Works when the effect of a block on the state has a compact composite, a
    vector of fixed length: ``summarise(rows)`` gives it, ``compose(composites)``
    the one of several blocks in order, ``walk(state, composites)`` the states
    that enter each of them and, last, the one behind them; ``apply(rows, state)``
    replays a block. Rows come as pandas frames in order.

    The block table is scanned as a tree: up, every ``fan`` composites make one;
    down, every group of ``fan`` is walked from the state that enters it. So no
    task holds more than ``fan`` composites of blocks, and of their groups no
    more than a series of ``fan`` * ``fan`` blocks has (5 * 10^10 rows with the
    defaults): the series' length is never walked in one place.
    """
    by = list(key.by)
    rows = row_positions(df, key).withColumn(BLOCK, F.floor((F.col(POS) - 1) / F.lit(block_rows)).cast("long"))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in [*by, BLOCK]}, "m": np.asarray(summarise(pdf), dtype=float)}])

    def up(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([compose(_stack(ms)) for ms in b.column(2)], pa.list_(pa.float64()))], names=[*b.schema.names, "total"])

    def down(batches):
        for b in batches:
            at, ks, states = [], [], []
            for i, (ms, totals) in enumerate(zip(b.column(1), b.column(2))):
                state = np.asarray(start, dtype=float)
                if len(totals):
                    state = walk(state, np.stack([np.asarray(t, dtype=float) for t in totals.as_py()]))[-1]
                states += list(walk(state, _stack(ms))[:-1])
                ks.append(ms.values.field(0).to_numpy())
                at += [i] * len(ks[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(np.concatenate(ks)), pa.array(states, pa.list_(pa.float64()))], names=["s", "k", "state"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    parts = rows.groupBy(*by, BLOCK).applyInPandas(summary, f"{fields}{', ' if by else ''}{BLOCK} long, m array<double>")
    series = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    some = parts.select(series.alias("s"), F.floor(F.col(BLOCK) / fan).cast("long").alias("u"), F.struct(F.col(BLOCK).alias("k"), "m").alias("e"))
    some = some.groupBy("s", "u").agg(F.sort_array(F.collect_list("e")).alias("ms"))
    struct = some.schema["s"].dataType.simpleString()
    some = some.mapInArrow(up, f"s {struct}, u long, ms array<struct<k: long, m: array<double>>>, total array<double>")
    earlier = F.collect_list("total").over(Window.partitionBy("s").orderBy("u").rowsBetween(Window.unboundedPreceding, -1))
    states = some.select("s", "ms", earlier.alias("totals")).mapInArrow(down, f"s {struct}, k long, state array<double>")
    states = states.select(F.struct(*[F.col(f"s.{k}") for k in by], F.col("k").alias(BLOCK)).alias(PART), F.col("state").alias("__state"))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        return apply(pdf, np.asarray(pdf["__state"].iloc[0], dtype=float))

    block = F.struct(*by, BLOCK).alias(PART)  # null keys are equal inside a struct
    return rows.select("*", block).join(states, PART).drop(PART).groupBy(*by, BLOCK).applyInPandas(replay, out_schema)


def _stack(members: pa.Scalar) -> np.ndarray:
    """The composites of a list of (k, m), one in a row."""
    m = members.values.field(1)
    return m.flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1)
