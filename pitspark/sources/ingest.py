"""Conforming raw tables and reconciling sources, as DataFrame operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.functions.mathfn import finite


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate heterogeneous sources; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prefer_sources(frames: Mapping[str, DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key and column the first non-null value in source order, plus the
    name of the best source. A tagged union and one partial aggregate instead
    of a chain of outer joins."""
    tagged = [
        f.select(*keys, *values).withColumn("__rank", F.lit(i)).withColumn("__name", F.lit(n))
        for i, (n, f) in enumerate(frames.items())
    ]
    best = [F.min_by(F.col(v), F.when(F.col(v).isNotNull(), F.col("__rank"))).alias(v) for v in values]
    return union_sources(tagged).groupBy(*keys).agg(*best, F.min_by("__name", "__rank").alias("source"))


def incremental_upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows plus incoming rows with new keys (existing rows win);
    duplicates inside the new batch collapse to one row per key."""
    cols = [c for c in incoming.columns if c not in keys]
    fresh = incoming.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("__v")).select(*keys, "__v.*")
    new = fresh.join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def melt_numeric(df: DataFrame, ids: Sequence[str], values: Sequence[str], *, series: str = "series", value: str = "value") -> DataFrame:
    """Wide to long with numeric coercion; missing and non-numeric cells drop."""
    text = df.select(*ids, *[F.col(v).cast("string").alias(v) for v in values])
    long = text.unpivot(list(ids), list(values), series, value)
    return long.withColumn(value, finite(F.col(value).try_cast("double"))).filter(F.col(value).isNotNull())


def quarter_start(label: Column) -> Column:
    """First day of a quarter written as ``Q1 2000``."""
    q = F.regexp_extract(label, r"^Q([1-4]) (\d{4})$", 1).try_cast("int")
    y = F.regexp_extract(label, r"^Q([1-4]) (\d{4})$", 2).try_cast("int")
    return F.make_date(y, q * 3 - 2, F.lit(1)).cast("timestamp_ntz")


def settled_days(df: DataFrame, day: str, as_of: str) -> DataFrame:
    """Rows of days that are over at an explicit as-of date."""
    return df.filter(F.to_date(day) < F.lit(as_of).cast("date"))


def conform_bars(raw: DataFrame, *, symbol: str, epoch_ms: str, fields: Mapping[str, str], minutes: int = 30) -> DataFrame:
    """Vendor bar rows to the bar contract: epoch milliseconds to UTC time,
    numeric coercion, visibility at bar end."""
    start = F.timestamp_millis(F.col(epoch_ms).cast("long")).cast("timestamp_ntz")
    cols = [finite(F.col(src).try_cast("double")).alias(dst) for dst, src in fields.items()]
    out = raw.select(F.upper(F.trim(symbol)).alias("symbol"), start.alias("timestamp"), *cols)
    end = F.col("timestamp") + F.expr(f"interval {minutes} minutes")
    return out.filter(F.col("timestamp").isNotNull()).withColumn("release_ts", end).withColumn("t_visible", end)


def clean_header(df: DataFrame) -> DataFrame:
    """Delimited-report headers: trimmed, spaces to underscores."""
    return df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])


def pick_report_columns(df: DataFrame, *, exact: Mapping[str, str], containing: Mapping[str, str]) -> DataFrame:
    """Select numeric columns of a report by exact name or by name fragment;
    absent ones become NULL, non-numeric cells become NULL."""
    out: list[Column] = []
    for dst, src in exact.items():
        found = src if src in df.columns else None
        out.append((F.col(found).try_cast("double") if found else F.lit(None).cast("double")).alias(dst))
    for dst, part in containing.items():
        found = next((c for c in df.columns if part in c), None)
        out.append((F.col(found).try_cast("double") if found else F.lit(None).cast("double")).alias(dst))
    return df.select("*", *out)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, non_null_share, n_rows) from one aggregate pass."""
    cols = list(columns or df.columns)
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(c)).alias(c) for c in cols])
    long = stats.unpivot(["n_rows"], cols, "column", "n")
    return long.select("column", (F.col("n") / F.col("n_rows")).alias("non_null_share"), "n_rows")
