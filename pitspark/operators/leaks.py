"""Does an operator see the future? Its values on the rows up to an instant must equal those on all rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.operators.chunked import SeriesKey

CUT = "cut_no"


def prefix_changes(
    df: DataFrame, key: SeriesKey, cuts: Sequence[dt.datetime], op: Callable[[DataFrame, SeriesKey], DataFrame], values: Sequence[str], places: int = 9
) -> DataFrame:
    """(value, cut, n_rows, n_changed): for each value and cut, the rows up to the cut and how many of them have another
    value than with all rows (rounded to ``places``; NULL equals NULL; a row that the operator drops counts as NULL).

    All cuts run in one job: a row is tagged with every cut it belongs to, and with 0 for the whole, and the tag
    leads the series key. The work is that of the operator times the number of cuts. ``key.order`` must be
    unique inside a series.
    """
    tags = [F.when(F.col(key.time) <= F.lit(c), F.lit(i)) for i, c in enumerate(cuts, 1)]
    tagged = df.withColumn(CUT, F.explode(F.array_compact(F.array(F.lit(0), *tags))))
    seen = op(tagged, SeriesKey((CUT, *key.by), key.time, key.tie, key.chunk_seconds))
    row = [*key.by, *key.order]
    body = F.struct(*[F.round(F.col(v).cast("double"), places).alias(v) for v in values])
    there = _null_safe(tagged.select(*row, CUT), seen.select(*row, CUT, body.alias("__v")), [*row, CUT])
    both = there.groupBy(*row).agg(
        F.max(F.when(F.col(CUT) == 0, F.col("__v"))).alias("whole"), F.collect_list(F.when(F.col(CUT) > 0, F.struct(F.col(CUT).alias("no"), F.col("__v").alias("v")))).alias("cuts")
    )  # a row has one entry for each cut at most
    pairs = both.select("whole", F.explode("cuts").alias("c"))
    long = pairs.select(F.col("c.no").alias("no"), F.explode(F.array(*[F.struct(F.lit(v).alias("value"), (~F.col(f"c.v.{v}").eqNullSafe(F.col(f"whole.{v}"))).alias("changed")) for v in values])).alias("x"))
    counts = long.groupBy(F.col("x.value").alias("value"), "no").agg(F.count("*").alias("n_rows"), F.count_if("x.changed").alias("n_changed"))
    when = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("no"))
    return counts.select("value", when.alias("cut"), "n_rows", "n_changed")


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on a struct, in which null keys are equal."""
    r = right.select(F.struct(*on).alias("__k"), *[c for c in right.columns if c not in on])
    return left.withColumn("__k", F.struct(*on)).join(r, "__k", "left").drop("__k")
