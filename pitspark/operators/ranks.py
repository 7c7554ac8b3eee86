"""Exact ranks and quantiles without sorting a whole group in one task.

Cut points from a bounded sketch split the value range of each group into
bins; bins are counted, their running totals give offsets, and only rows of
one bin are ever sorted together. The sketch only balances the work: results
are exact whatever its error. Values as frequent as a cut point get bins of
their own that are split further by the tie-breaker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.operators.chunked import Running, SeriesKey, row_positions, running

# Cut points per group; one bin of one group is the most a task ever sorts, so
# raise ``bins`` with the size of the largest group.
BINS = 256
ALL = "__all"


def _cuts(value: str, bins: int) -> Column:
    """Aggregate: sorted distinct cut points of a column."""
    fractions = ", ".join(f"{i / bins!r}D" for i in range(1, bins))
    return F.expr(f"array_sort(array_distinct(percentile_approx(`{value}`, array({fractions}), {8 * bins})))")


def _below(cuts: Column, v: Column, bins: int) -> Column:
    """Number of cut points strictly below a value, by binary search: each step is taken if the cut it ends at is below."""
    steps = [F.lit(1 << i) for i in reversed(range(max(1, bins.bit_length())))]
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) < v, step).otherwise(F.lit(0)))


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(ALL, F.lit(0)), [ALL])


def value_ranks(df: DataFrame, by: Sequence[str], value: str, bins: int = BINS) -> DataFrame:
    """Distinct values per group with their count ``n``, the number of rows up
    to and including them ``upto`` and the group's ``n_values``.

    Repeats collapse before the shuffle, and every later step reads that one
    shuffle again (reused exchange).
    """
    src, keys = _grouped(df, by)
    distinct = src.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    meta = distinct.groupBy(*keys).agg(_cuts(value, bins).alias("__cuts"), F.sum("n").alias("n_values"))
    cut = distinct.join(meta, keys)
    chunked = cut.withColumn("__bin", _below(F.col("__cuts"), F.col(value), bins)).drop("__cuts")
    key = SeriesKey(tuple(keys), value)
    return running(chunked, key, [Running("upto", "sum", F.col("n"))], chunk=F.col("__bin")).drop("__bin")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, fractions: dict[str, float], bins: int = BINS) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per fraction,
    plus the number of values ``n_values``."""
    ranks = value_ranks(df, by, value, bins)
    keys = list(by) if by else [ALL]
    first = F.col("upto") - F.col("n")  # 0-based rank of the first copy

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("upto")), F.col(value)))

    aggs: list[Column] = [F.max("n_values").alias("n_values")]
    for name, q in fractions.items():
        target = F.lit(q) * (F.col("n_values") - 1)
        aggs += [at(F.floor(target)).alias(f"__lo_{name}"), at(F.ceil(target)).alias(f"__hi_{name}")]
        aggs.append(F.max(target - F.floor(target)).alias(f"__w_{name}"))
    out = ranks.groupBy(*keys).agg(*aggs)
    for name in fractions:
        lo, hi, w = (F.col(f"__{p}_{name}") for p in ("lo", "hi", "w"))
        out = out.withColumn(name, lo + (hi - lo) * w)
    return out.select(*by, "n_values", *fractions)


def order_statistic(
    df: DataFrame, by: Sequence[str], value: str, rank: Column, out: str, bins: int = BINS
) -> DataFrame:
    """The value at a 1-based rank per group; ``rank`` may use ``n_values``."""
    ranks = value_ranks(df, by, value, bins)
    keys = list(by) if by else [ALL]
    hit = (F.col("upto") - F.col("n") < rank) & (rank <= F.col("upto"))
    picked = ranks.groupBy(*keys).agg(F.max("n_values").alias("n_values"), F.max(F.when(hit, F.col(value))).alias(out))
    return picked.select(*by, "n_values", out)


def row_ranks(
    df: DataFrame, by: Sequence[str], value: str, tie: str, *, out: str, tie_width: int = 100_000, bins: int = BINS
) -> DataFrame:
    """1-based rank of every row by (value, tie); ``tie`` is a unique integer."""
    src, keys = _grouped(df, by)
    cut = src.join(src.groupBy(*keys).agg(_cuts(value, bins).alias("__cuts")), keys)
    v, cuts = F.col(value), F.col("__cuts")
    on_cut = F.array_contains(cuts, v)
    chunk = F.struct(
        (_below(cuts, v, bins) * 2 + on_cut.cast("int")).alias("bin"),
        F.when(on_cut, F.floor(F.col(tie) / tie_width)).otherwise(F.lit(0)).alias("part"),
    )
    key = SeriesKey(tuple(keys), value, (tie,))
    ranked = row_positions(cut.withColumn("__bin", chunk).drop("__cuts"), key, pos=out, chunk=F.col("__bin"))
    return ranked.select(*df.columns, out)
