"""Point-in-time enrichment of a stream with a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pitspark.operators.asof import asof_join


def enrich_asof(
    stream: DataFrame,
    load_table: Callable[[], DataFrame],
    write: Callable[[DataFrame, int], None],
    *,
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    checkpoint: str,
) -> StreamingQuery:
    """Strict as-of join of every micro-batch with the current table.

    The table is read again for each batch, so new releases are seen; ``write``
    gets the batch id and should be idempotent on it.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        out = asof_join(
            batch, load_table(), left_time=left_time, right_time=right_time, strict=True, columns=columns, by=by, tie=tie
        )
        write(out, batch_id)

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
