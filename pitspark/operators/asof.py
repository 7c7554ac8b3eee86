"""As-of joins: the latest (or next) right row for every left row.

Both sides are tagged, unioned and partitioned by (key, time bucket); inside a
bucket a window carries the last right row forward, and the last right row of
all earlier buckets comes from the small bucket table. One shuffle of the
data, no nested loop, and a dominant key is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.functions.timefn import micros, time_chunk
from pitspark.operators.chunked import shared_shuffle

DAY = 86_400


NO_BUCKET = -(1 << 62)


def _total_keys(df: DataFrame, by: Sequence[str]) -> list[Column]:
    """Non-null stand-ins for the join keys, so that left rows without a key
    stay (unmatched) while both plan branches see the same, null-free keys."""
    out: list[Column] = []
    for i, f in enumerate(df.select(*by).schema):
        text = isinstance(f.dataType, T.StringType)
        default = F.lit("" if text else 0).cast("string" if text else "long")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            default = F.lit("1970-01-01")
        out.append(F.coalesce(F.col(f.name), default.cast(f.dataType)).alias(f"__k{i}"))
        out.append(F.col(f.name).isNull().alias(f"__n{i}"))
    return out


def _neighbour(
    left: DataFrame,
    right: DataFrame,
    *,
    left_time: str,
    right_time: str,
    by: Sequence[str],
    columns: Sequence[str],
    tie: Sequence[str],
    plans: Sequence[tuple[str, str, bool]],
    bucket_seconds: int,
) -> DataFrame:
    """Attach, per plan (output struct name, direction, strict), the nearest
    right row. All plans share the shuffle; each direction costs one sort."""
    by = list(by)
    payload = F.struct(
        F.col(right_time).alias("t"), *[F.col(c).alias(f"c_{c}") for c in columns]
    )
    r = right.filter(F.col(right_time).isNotNull())
    for k in by:
        r = r.filter(F.col(k).isNotNull())
    keys = [f"__{p}{i}" for i in range(len(by)) for p in "kn"]
    rows_r = r.select(
        *_total_keys(r, by),
        F.col(right_time).alias("__t"),
        F.struct(F.lit(0).alias("z"), *[F.col(c).alias(f"t_{c}") for c in tie]).alias("__tie"),
        payload.alias("__r"),
    ).withColumn("__l", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType))
    rows_l = left.select(
        *_total_keys(left, by),
        F.col(left_time).alias("__t"),
        F.struct("*").alias("__l"),
    )
    both = rows_l.unionByName(rows_r, allowMissingColumns=True).withColumn(
        "__b", F.coalesce(time_chunk(F.col("__t"), bucket_seconds), F.lit(NO_BUCKET))
    )
    by = keys
    both, zero = shared_shuffle(both, [*by, "__b"])
    is_right = F.col("__r").isNotNull()
    ins: dict[str, Column] = {}
    carries: list[Column] = []
    span = Window.partitionBy(*by).orderBy("__b")
    picks = []
    for name, direction, strict in plans:
        back = direction == "backward"
        side = F.when(is_right, 1 if strict else 0).otherwise(0 if strict else 1)
        when = F.col("__t") if back else F.col("__t").desc()
        tie_order = F.col("__tie") if back else F.col("__tie").desc()
        w = (
            Window.partitionBy(*by, "__b")
            .orderBy(when, side, tie_order)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        ins[f"__in_{name}"] = F.last("__r", ignorenulls=True).over(w)
        rank = F.when(is_right, F.struct("__t", "__tie"))
        picks.append((F.max_by if back else F.min_by)("__r", rank).alias(f"__p_{name}"))
        edge = (
            span.rowsBetween(Window.unboundedPreceding, -1)
            if back
            else Window.partitionBy(*by).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
        )
        carries.append(F.last(f"__p_{name}", ignorenulls=True).over(edge).alias(f"__c_{name}"))
    table = (
        both
        .groupBy(*by, "__b")
        .agg(F.max(zero).alias("__z"), *picks)
        .filter(F.col("__z") == 0)
        .select(*by, "__b", *carries)
    )
    out = both.withColumns(ins).filter(F.col("__l").isNotNull()).join(table, [*by, "__b"], "left")
    timed = F.col("__b") != NO_BUCKET
    return out.select(
        "__l.*",
        *[F.when(timed, F.coalesce(f"__in_{n}", f"__c_{n}")).alias(n) for n, _, _ in plans],
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    left_time: str,
    right_time: str,
    strict: bool,
    columns: Sequence[str],
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    direction: str = "backward",
    tolerance_seconds: float | None = None,
    prefix: str = "",
    matched_time: str | None = None,
    bucket_seconds: int = DAY,
) -> DataFrame:
    """Left outer as-of join.

    ``backward`` finds the last right row before the left time, ``forward`` the
    first one after it; ``strict`` excludes equal times. ``tie`` orders right
    rows that share a time (the highest wins backward, the lowest forward).
    ``tolerance_seconds`` (inclusive) turns a match that is too far away into
    NULL. ``matched_time`` names an output column with the matched right time.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    out = _neighbour(
        left,
        right,
        left_time=left_time,
        right_time=right_time,
        by=by,
        columns=columns,
        tie=tie,
        plans=[("__m", direction, strict)],
        bucket_seconds=bucket_seconds,
    )
    if tolerance_seconds is not None:
        gap = F.abs(micros(F.col(left_time)) - micros(F.col("__m.t")))
        out = out.withColumn("__m", F.when(gap <= int(tolerance_seconds * 1_000_000), F.col("__m")))
    extra = [F.col(f"__m.c_{c}").alias(f"{prefix}{c}") for c in columns]
    if matched_time:
        extra.append(F.col("__m.t").alias(matched_time))
    return out.select(*left.columns, *extra)


def nearest_events(
    left: DataFrame,
    events: DataFrame,
    *,
    left_time: str,
    event_time: str,
    by: Sequence[str] = (),
    bucket_seconds: int = DAY * 30,
) -> DataFrame:
    """Attach ``prev_event`` (at or before) and ``next_event`` (at or after)."""
    out = _neighbour(
        left,
        events,
        left_time=left_time,
        right_time=event_time,
        by=by,
        columns=(),
        tie=(),
        plans=[("__prev", "backward", False), ("__next", "forward", False)],
        bucket_seconds=bucket_seconds,
    )
    return out.select(
        *left.columns,
        F.col("__prev.t").alias("prev_event"),
        F.col("__next.t").alias("next_event"),
    )


def event_within(prev_event: Column, next_event: Column, at: Column, seconds: int) -> Column:
    """True when an event lies in [at - seconds, at + seconds]."""
    limit = seconds * 1_000_000
    near_prev = micros(at) - micros(prev_event) <= limit
    near_next = micros(next_event) - micros(at) <= limit
    return F.coalesce(near_prev, F.lit(False)) | F.coalesce(near_next, F.lit(False))
