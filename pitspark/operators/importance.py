"""Feature-importance tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions.text import feature_category


def rollup(df: DataFrame, *, name: str, value: str) -> DataFrame:
    """Per category: number of features, mean and sum of |value|, top feature."""
    size = F.abs(F.col(value))
    return (
        df.withColumn("category", feature_category(F.col(name)))
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("n_features"),
            F.avg(size).alias("mean_abs"),
            F.sum(size).alias("sum_abs"),
            F.max_by(name, F.struct(size, F.col(name))).alias("top_feature"),
        )
    )


def top_per_category(df: DataFrame, *, name: str, value: str, n: int) -> DataFrame:
    """The ``n`` largest |value| per category; the rank limit is applied before
    the shuffle as well as after it."""
    w = Window.partitionBy("category").orderBy(F.abs(F.col(value)).desc(), F.col(name))
    tagged = df.withColumn("category", feature_category(F.col(name)))
    return tagged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def moments(df: DataFrame, features: Sequence[str], *, present: Column) -> DataFrame:
    """Mean, population deviation and bucket means per feature (one pass)."""
    p = F.coalesce(present, F.lit(False))
    aggs = []
    for f in features:
        v = F.col(f).cast("double")
        aggs.append(
            F.struct(
                F.avg(v).alias("mean"),
                F.stddev_pop(v).alias("std"),
                F.avg(F.when(p, v)).alias("mean_present"),
                F.avg(F.when(~p, v)).alias("mean_absent"),
            ).alias(f)
        )
    one = df.agg(*aggs)
    return one.unpivot([], list(features), "feature", "s").select("feature", "s.*")
