"""Walk-forward folds with embargo, as a column instead of a loop."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.operators.chunked import SeriesKey, row_positions

ROLES = ("train", "val", "test")


@dataclass(frozen=True)
class FoldSpec:
    """Window lengths of a walk-forward scheme."""

    n_folds: int = 4
    train_months: int = 36
    val_months: int = 6
    test_months: int = 6
    step_months: int = 3
    embargo_days: int = 7


def _months(ts: Column, n: Column | int) -> Column:
    m = F.lit(n) if isinstance(n, int) else n
    return ts + F.make_ym_interval(F.lit(0), m)


def fold_table(df: DataFrame, by: Sequence[str], time: str, spec: FoldSpec = FoldSpec()) -> DataFrame:
    """One row per (series, fold) with half-open window bounds. Folds whose test
    window ends after the last row are left out."""
    ends = df.groupBy(*by).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    f = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(spec.n_folds - 1))).alias("fold"))
    gap = F.expr(f"interval {spec.embargo_days} days")
    f = f.withColumn("train_start", _months(F.col("__lo"), F.col("fold") * spec.step_months))
    f = f.withColumn("train_end", _months(F.col("train_start"), spec.train_months))
    f = f.withColumn("val_start", F.col("train_end") + gap)
    f = f.withColumn("val_end", _months(F.col("val_start"), spec.val_months))
    f = f.withColumn("test_start", F.col("val_end") + gap)
    f = f.withColumn("test_end", _months(F.col("test_start"), spec.test_months))
    bounds = [f"{r}_{e}" for r in ROLES for e in ("start", "end")]
    return f.filter(F.col("test_end") <= F.col("__hi")).select(*by, F.col("fold").cast("long").alias("fold"), *bounds)


def assign_folds(df: DataFrame, folds: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Every row once per fold it belongs to, with its role.

    The fold table is packed to one short array per series, so the rows are
    joined by series only and expanded in place; no range join.
    """
    bounds = [c for c in folds.columns if c not in by]
    packed = folds.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*bounds))).alias("__folds"))

    def role(f: Column) -> Column:
        t = F.col(time)
        inside = lambda r: (t >= f[f"{r}_start"]) & (t < f[f"{r}_end"])
        return F.when(inside("train"), "train").when(inside("val"), "val").when(inside("test"), "test")

    hits = F.filter(
        F.transform("__folds", lambda f: F.struct(f["fold"].alias("fold"), role(f).alias("role"))),
        lambda x: x["role"].isNotNull(),
    )
    joined = df.join(packed, list(by))
    return joined.select(*df.columns, F.explode(hits).alias("__h")).select(*df.columns, "__h.fold", "__h.role")


def fold_sizes(assigned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per role and whether the fold is well-formed: no empty role and
    train before val before test."""
    t = [F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ROLES]
    return assigned.groupBy(*by, "fold").agg(*t)


def malformed(folds: DataFrame, sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fold table with sizes and an ``ok`` flag."""
    j = folds.join(sizes, [*by, "fold"], "left").fillna(0, [f"n_{r}" for r in ROLES])
    ordered = (F.col("train_end") <= F.col("val_start")) & (F.col("val_end") <= F.col("test_start"))
    filled = (F.col("n_train") > 0) & (F.col("n_val") > 0) & (F.col("n_test") > 0)
    return j.withColumn("ok", ordered & filled)


def split_validation(val: DataFrame, key: SeriesKey) -> DataFrame:
    """Chronological a / b / c slices (50 / 25 / 25 % by row position)."""
    by = list(key.by)
    sizes = val.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    pos = row_positions(val, key, pos="__p").join(sizes, by)
    half, quarter = F.floor(F.col("__n") / 2), F.floor(F.col("__n") / 4)
    i = F.col("__p") - 1
    part = F.when(i < half, "a").when(i < half + quarter, "b").otherwise("c")
    return pos.withColumn("val_slice", part).drop("__p", "__n")
