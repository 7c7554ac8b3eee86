"""State with event-time timers.

Rows may arrive out of order inside and across micro-batches. They are appended
to list state and wait there until the watermark has passed them; a timer at
the earliest waiting row then applies them in time order. Between batches a key
keeps its value state and the rows still waiting, so its size is bounded by the
lateness allowance. A key without rows for ``idle_seconds`` of event time is
forgotten. Rows behind the watermark are dropped by Spark and counted in
``numRowsDroppedByWatermark``, so a key is never applied out of order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pitspark.functions.timefn import micros

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and list state need the RocksDB store; another choice of the
    session that is not Spark's default is left alone."""
    now = spark.conf.get(PROVIDER, "")
    if not now or now.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


class OrderedState(StatefulProcessor):
    """Waiting rows (first field: microseconds), a value state and one timer."""

    def __init__(self, wait: T.StructType, core: T.StructType, idle_seconds: int | None = None):
        self.wait_schema, self.core_schema, self.idle = wait, core, idle_seconds

    def arrive(self, row: Row) -> tuple:
        """The waiting form of an input row."""
        raise NotImplementedError

    def apply(self, key: tuple, core: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[Row]]:
        """New value state and output rows of waiting rows whose time has come."""
        raise NotImplementedError

    def start(self, row: Row) -> tuple | None:
        """Value state from a row of the initial table."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait = handle.getListState("wait", self.wait_schema)
        self.core = handle.getValueState("core", self.core_schema)
        self.timer = handle.getValueState("timer", T.StructType([T.StructField("at", T.LongType())]))

    def _alarm(self, at: int | None) -> None:
        if self.timer.exists():
            old = self.timer.get()[0]
            if old == at:
                return
            self.handle.deleteTimer(old)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [self.arrive(r) for r in rows]
        timed = [r for r in new if r[0] is not None]
        if len(timed) < len(new):
            yield from self.apply(tuple(key), None, [r for r in new if r[0] is None])[1]
        if timed:
            had = self.wait.exists()
            self.wait.appendList(timed)
            due = min(r[0] for r in timed) // 1000 + 1
            if had and self.timer.exists():
                due = min(due, self.timer.get()[0])
            self._alarm(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        rows = list(self.wait.get()) if self.wait.exists() else []
        if not rows:
            self.core.clear()
            return
        ready = [r for r in rows if r[0] < mark * 1000]
        later = [r for r in rows if r[0] >= mark * 1000]
        if later:
            self.wait.put(later)
            self._alarm(min(r[0] for r in later) // 1000 + 1)
        else:
            self.wait.clear()
            if self.idle is not None:
                self._alarm(mark + self.idle * 1000)
        core, out = self.apply(tuple(key), self.core.get() if self.core.exists() else None, ready)
        if core is not None:
            self.core.update(core)
        yield from out

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        core = self.start(initialState)
        if core is not None:
            self.core.update(core)

    def close(self) -> None:
        pass


def null_safe(values: Sequence[Any]) -> tuple:
    """Sort key that puts missing values first."""
    return tuple((v is not None, v) for v in values)


class _AsOf(OrderedState):
    def __init__(self, left: T.StructType, right: T.StructType, keys: int, tie: Sequence[str], strict: bool, tolerance: int | None):
        names = [f.name for f in right]
        self.n_left, self.keys, self.strict, self.tolerance = len(left), keys, strict, tolerance
        self.tie = [names.index(c) for c in tie]
        self.out = [f.name for f in left] + names
        head = [T.StructField("us", T.LongType()), T.StructField("side", T.IntegerType())]
        body = [T.StructField(f"l{i}", f.dataType) for i, f in enumerate(left)]
        tail = [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(right)]
        super().__init__(T.StructType([*head, *body, *tail]), T.StructType([head[0], *tail]), tolerance)

    def arrive(self, row: Row) -> tuple:
        return tuple(row)[self.keys : -1]

    def start(self, row: Row) -> tuple | None:
        return tuple(row)[self.keys :]

    def apply(self, key: tuple, core: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[Row]]:
        cut = 2 + self.n_left
        first = 0 if self.strict else 1  # the side that comes first among equal times: 0 left, 1 right

        def order(r: tuple) -> tuple:
            return (r[0] or 0, 0 if r[1] == first else 1, null_safe([r[cut + i] for i in self.tie]) if r[1] == 1 else ())

        out, blank = [], (None,) * (len(self.out) - self.n_left)
        make = Row(*self.out)
        for r in sorted(rows, key=order):
            if r[1] == 1:
                if core is None or r[0] >= core[0]:
                    core = (r[0], *r[cut:])
                continue
            seen = core is not None and r[0] is not None and (core[0] < r[0] or (core[0] == r[0] and not self.strict))
            if seen and self.tolerance is not None:
                seen = r[0] - core[0] <= self.tolerance * 1_000_000
            out.append(make(*r[2:cut], *(core[1:] if seen else blank)))
        return core, out


def stream_asof(
    left: DataFrame,
    right: DataFrame,
    *,
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    lateness: str,
    strict: bool,
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    known: DataFrame | None = None,
    tolerance_seconds: int | None = None,
    lanes: int = 1,
) -> DataFrame:
    """As-of join of two streams: every left row with the latest right row before
    it, emitted once the watermark has passed the left row.

    Both streams meet in one keyed state, so a release is shuffled once and not
    again with every batch. The watermark follows whichever stream is ahead: a
    stream of rare releases does not hold the bars up, and a release that comes
    more than ``lateness`` behind is dropped. ``known`` is a batch table of
    right rows that precede the stream; the latest of each key is the initial
    state. Equal right times are decided by ``tie`` (columns of the right side;
    the last wins). ``lanes`` spreads the left rows of a hot key, or of a join
    without keys, over that many states; right rows are copied to each.

    Rows without a time or with a null key come out unmatched; such right rows
    are ignored. With ``tolerance_seconds`` older right rows do not match and a
    key without rows for that long is forgotten.
    """
    use_rocksdb(left.sparkSession)
    by, want = list(by), list(dict.fromkeys([*columns, *tie]))
    clash = [c for c in want if c in left.columns]
    if clash:
        raise ValueError(f"columns on both sides, rename them first: {clash}")
    ltypes = T.StructType(list(left.schema))
    rtypes = T.StructType([right.schema[c] for c in want])
    names_l, names_r = [f"l{i}" for i in range(len(ltypes))], [f"r{i}" for i in range(len(rtypes))]
    keys = [f"k{i}" for i in range(len(by))] + ["lane"]

    def keyed(df: DataFrame) -> list:
        return [F.col(c).alias(k) for c, k in zip(by, keys)]

    all_lanes = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    own_lane = F.pmod(F.xxhash64(*left.columns), F.lit(lanes)).cast("int").alias("lane")
    at = F.col(left_time).cast("timestamp")
    rows_l = left.select(
        *keyed(left), own_lane, micros(F.col(left_time)).alias("us"), F.lit(0).alias("side"),
        *[F.col(f.name).alias(n) for f, n in zip(ltypes, names_l)],
        *[F.lit(None).cast(f.dataType).alias(n) for f, n in zip(rtypes, names_r)], at.alias("at"),
    )

    def usable(df: DataFrame) -> DataFrame:
        return df.dropna(subset=[right_time, *by])

    rows_r = usable(right).select(
        *keyed(right), all_lanes, micros(F.col(right_time)).alias("us"), F.lit(1).alias("side"),
        *[F.lit(None).cast(f.dataType).alias(n) for f, n in zip(ltypes, names_l)],
        *[F.col(c).alias(n) for c, n in zip(want, names_r)], F.col(right_time).cast("timestamp").alias("at"),
    )
    both = rows_l.unionByName(rows_r).withWatermark("at", lateness)
    start = None
    if known is not None:
        rank = F.struct(right_time, *tie)
        latest = usable(known).groupBy(*by).agg(
            F.max(micros(F.col(right_time))).alias("us"), F.max_by(F.struct(*want), rank).alias("__r"), F.count(F.lit(1)).alias("__n")
        ).filter(F.col("__n") > 0)
        start = latest.select(
            *keyed(latest), all_lanes, "us", *[F.col(f"__r.{c}").alias(n) for c, n in zip(want, names_r)]
        ).groupBy(*keys)
    processor = _AsOf(ltypes, rtypes, len(keys), list(tie), strict, tolerance_seconds)
    out = T.StructType([T.StructField(f.name, f.dataType) for f in [*ltypes, *rtypes]])
    joined = both.groupBy(*keys).transformWithState(processor, out, "append", "EventTime", start)
    return joined.select(*left.columns, *columns)


class RecursionState(OrderedState):
    """A recursion with a flat double state over waiting rows of doubles."""

    def __init__(self, recursion: Any, key: str, time: str, values: Sequence[str], out: Sequence[str], idle_seconds: int | None):
        self.recursion, self.names = recursion, [key, time, *values, *out]
        self.n, self.scalar = len(values), len(out) == 1
        double = T.ArrayType(T.DoubleType())
        super().__init__(
            T.StructType([T.StructField("us", T.LongType()), T.StructField("x", double)]),
            T.StructType([T.StructField("core", double)]), idle_seconds,
        )

    def arrive(self, row: Row) -> tuple:
        return row["us"], [None if v is None else float(v) for v in row["x"]]

    def start(self, row: Row) -> tuple | None:
        return ([float(v) for v in row["core"]],)

    def apply(self, key: tuple, core: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[Row]]:
        state = list(core[0]) if core is not None else self.recursion.start()
        out, make = [], Row(*self.names)
        for us, xs in sorted(rows, key=lambda r: r[0] or 0):
            if us is None:
                out.append(make(key[0], None, *xs, *([None] * (len(self.names) - 2 - self.n))))
                continue
            state, y = self.recursion.step(state, *xs)
            out.append(make(key[0], us, *xs, *((float(y),) if self.scalar else map(float, y))))
        return (list(map(float, state)),), out
