"""Incremental ingest with a journaled cursor.

The cursor of a feed is the offset of a Spark stream: (microseconds) up to which
the feed has been read. Spark writes the range of a batch to its checkpoint
before the batch runs and marks it done afterwards, so a stop or a crash between
batches loses nothing, and a sink that knows the batch (files, an idempotent
upsert) repeats nothing.

The range between two cursors is cut into windows of ``window_seconds``; each
window is read by one task, page by page, following (time, id), so rows of one
instant may fill any number of pages and memory holds one page. A row may come
into the feed up to ``settle_seconds`` after its time; younger windows wait.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

EPOCH = dt.datetime(1970, 1, 1)


class Feed:
    """What a source has to offer. Rows are Arrow tables in (time, id) order;
    rows without a time or an id belong to no page."""

    time: str
    id: str

    def schema(self) -> Any:
        """Arrow schema of the rows."""
        raise NotImplementedError

    def span(self) -> tuple[int, int]:
        """First time and the time below which the feed has rows, in
        microseconds; equal numbers where it is empty."""
        raise NotImplementedError

    def page(self, lo: int, hi: int, after: tuple[int, Any] | None, limit: int) -> Any:
        """The first ``limit`` rows with lo <= time < hi that follow ``after``."""
        raise NotImplementedError


class TableFeed(Feed):
    """A Parquet folder or file that other jobs append to; the time range is
    pushed to the row groups."""

    def __init__(self, path: str, time: str, id: str, columns: Sequence[str] | None = None):
        self.path, self.time, self.id = path, time, id
        self.columns = list(dict.fromkeys([time, id, *(columns or [])])) if columns else None

    def _dataset(self) -> Any:
        from pyarrow import dataset

        where = "/" + self.path[5:].lstrip("/") if self.path.startswith("file:") else self.path
        return dataset.dataset(where, format="parquet")

    def schema(self) -> Any:
        import pyarrow as pa

        s = self._dataset().schema
        return pa.schema([s.field(c) for c in self.columns]) if self.columns else s.remove_metadata()

    def _micros(self, value: Any) -> int:
        import pyarrow as pa

        return value.cast(pa.timestamp("us")).cast(pa.int64()).as_py()

    def span(self) -> tuple[int, int]:
        import pyarrow as pa
        import pyarrow.compute as pc

        lows, highs = [], []
        for fragment in self._dataset().get_fragments():
            meta = fragment.metadata
            column = meta.schema.names.index(self.time)
            for k in range(meta.num_row_groups):
                chunk = meta.row_group(k).column(column)
                if chunk.physical_type != "INT96" and chunk.is_stats_set and chunk.statistics.has_min_max:
                    low, high = chunk.statistics.min, chunk.statistics.max
                else:  # no usable statistics: read this column
                    times = fragment.subset(row_group_ids=[k]).to_table(columns=[self.time])[self.time]
                    low, high = pc.min_max(times).as_py().values()
                if low is not None:
                    lows.append(self._micros(pa.scalar(low)))
                    highs.append(self._micros(pa.scalar(high)))
        return (min(lows), max(highs) + 1) if lows else (0, 0)

    def page(self, lo: int, hi: int, after: tuple[int, Any] | None, limit: int) -> Any:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import dataset

        data, want = self._dataset(), self.schema()

        def at(us: int) -> Any:
            return pa.scalar(us, pa.timestamp("us")).cast(data.schema.field(self.time).type)

        time, key = dataset.field(self.time), dataset.field(self.id)
        cond = (time >= at(lo)) & (time < at(hi)) & key.is_valid()
        if after is not None:
            cond = cond & ((time > at(after[0])) | ((time == at(after[0])) & (key > after[1])))
        order = [(self.time, "ascending"), (self.id, "ascending")]
        best = want.empty_table()
        for batch in data.to_batches(columns=want.names, filter=cond, batch_size=max(limit, 1024)):
            if batch.num_rows:
                best = pa.concat_tables([best, pa.Table.from_batches([batch]).cast(want)])
                best = best.take(pc.select_k_unstable(best, limit, order))
        return best


@dataclass
class Window(InputPartition):
    lo: int
    hi: int


class _Pages:
    """Windows of a range and the rows of one."""

    def __init__(self, options: dict, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.feed = _feed(options)
        self.arrow = to_arrow_schema(schema)
        self.width = int(float(options.get("window_seconds", 86_400)) * 1_000_000)
        self.limit = int(options.get("page", 10_000))
        self.settle = int(float(options.get("settle_seconds", 0)) * 1_000_000)

    def horizon(self) -> int:
        lo, hi = self.feed.span()
        return max(lo, hi - self.settle)

    def windows(self, lo: int, hi: int) -> list[Window]:
        if hi <= lo:
            return []
        inner = range((lo // self.width + 1) * self.width, hi, self.width)
        cuts = [lo, *inner, hi]
        return [Window(a, b) for a, b in zip(cuts, cuts[1:])]

    def rows(self, window: Window) -> Iterator[Any]:
        import pyarrow as pa

        after = None
        while True:
            page = self.feed.page(window.lo, window.hi, after, self.limit)
            yield from page.cast(self.arrow).to_batches()
            if page.num_rows < self.limit:
                return
            last = page.slice(page.num_rows - 1)
            us = last[self.feed.time][0].cast(pa.timestamp("us")).cast(pa.int64()).as_py()
            after = (us, last[self.feed.id][0].as_py())


class _Batch(DataSourceReader):
    def __init__(self, pages: _Pages):
        self.pages = pages

    def partitions(self) -> Sequence[InputPartition]:
        return self.pages.windows(self.pages.feed.span()[0], self.pages.horizon()) or [Window(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[Any]:
        return self.pages.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, pages: _Pages, start: str | None):
        self.pages, self.start = pages, start

    def initialOffset(self) -> dict:
        if self.start is not None:
            return {"cursor": (dt.datetime.fromisoformat(self.start) - EPOCH) // dt.timedelta(microseconds=1)}
        return {"cursor": self.pages.feed.span()[0]}

    def latestOffset(self) -> dict:
        return {"cursor": self.pages.horizon()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.pages.windows(start["cursor"], end["cursor"])

    def read(self, partition: InputPartition) -> Iterator[Any]:
        return self.pages.rows(partition)


def _feed(options: dict) -> Feed:
    module, name = options["feed"].split(":")
    return getattr(importlib.import_module(module), name)(**json.loads(options["args"]))


class CursorFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor_feed"

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_feed(self.options).schema())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Batch(_Pages(self.options, schema))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(_Pages(self.options, schema), self.options.get("start"))


def _options(feed: type[Feed], args: dict, window_seconds: float, page: int, settle_seconds: float) -> dict[str, str]:
    return {
        "feed": f"{feed.__module__}:{feed.__qualname__}", "args": json.dumps(args), "window_seconds": str(window_seconds),
        "page": str(page), "settle_seconds": str(settle_seconds),
    }


def read_feed(
    spark: SparkSession, feed: type[Feed], args: dict, *, window_seconds: float = 86_400, page: int = 10_000, settle_seconds: float = 0
) -> DataFrame:
    """All rows of a feed up to its horizon, one task a window. ``feed`` is an
    importable class, ``args`` its JSON arguments."""
    spark.dataSource.register(CursorFeed)
    return spark.read.format("cursor_feed").options(**_options(feed, args, window_seconds, page, settle_seconds)).load()


def stream_feed(
    spark: SparkSession,
    feed: type[Feed],
    args: dict,
    *,
    start: str | None = None,
    window_seconds: float = 86_400,
    page: int = 10_000,
    settle_seconds: float = 0,
) -> DataFrame:
    """The same rows as a stream whose offset is the cursor. ``start`` (ISO time,
    UTC) is where a new journal begins; afterwards the checkpoint decides."""
    spark.dataSource.register(CursorFeed)
    options = _options(feed, args, window_seconds, page, settle_seconds)
    if start is not None:
        options["start"] = start
    return spark.readStream.format("cursor_feed").options(**options).load()
