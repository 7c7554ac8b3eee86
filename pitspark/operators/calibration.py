"""Calibrating classifier scores, per fold, with exact quantiles and ranks.

Scores are rows with an array of logits in class order; ``label`` is the class
index. Anything per class is done inside the row, so nothing is multiplied by
the number of classes unless a result per class is wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.functions.mathfn import let, rnd, softmax
from pitspark.operators.ranks import order_statistic, row_ranks

C = F.col
T_MIN, T_MAX = 0.7, 3.0
PROB_PLACES = 9


def nll(logits: Column, label: Column, t: Column) -> Column:
    """Negative log likelihood of the label at a temperature."""

    def loss(scaled: Column) -> Column:
        def given(top: Column) -> Column:
            total = F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
            return F.ln(total) + top - F.get(scaled, label.cast("int"))

        return let(F.array_max(scaled), given)

    return let(F.transform(logits, lambda x: x / t), loss)


def _best_on_grid(df: DataFrame, by: Sequence[str], grid: Column, out: str) -> DataFrame:
    """Grid point with the lowest mean loss per group: a loss array per row is
    averaged element-wise in one aggregate."""
    losses = F.transform(grid, lambda t: F.struct(t.alias("t"), nll(C("logits"), C("label"), t).alias("loss")))
    long = df.select(*by, F.posexplode(losses).alias("k", "p"))
    mean = long.groupBy(*by, "k").agg(F.avg("p.loss").alias("loss"), F.min("p.t").alias("t"))
    return mean.groupBy(*by).agg(F.min_by("t", F.struct("loss", "k")).alias(out))


def fit_temperature(df: DataFrame, by: Sequence[str], *, step: float = 0.1, fine: float = 0.005) -> DataFrame:
    """Temperature in [0.7, 3] minimising the NLL per group; groups with fewer
    than two classes get none. The loss is convex in 1/T, so a coarse grid and
    one refinement around its minimum find it to the fine step."""
    n = round((T_MAX - T_MIN) / step)
    coarse = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(T_MIN) + i * F.lit(step))
    classes = df.groupBy(*by).agg((F.min("label") < F.max("label")).alias("__ok")).filter("__ok").drop("__ok")
    usable = df.join(classes, list(by), "left_semi")
    rough = _best_on_grid(usable, by, coarse, "__t0")
    m = round(step / fine)
    near = F.transform(
        F.sequence(F.lit(-m), F.lit(m)),
        lambda i: F.greatest(F.least(C("__t0") + i * F.lit(fine), F.lit(T_MAX)), F.lit(T_MIN)),
    )
    return _best_on_grid(usable.join(rough, list(by)), by, near, "temperature")


def probabilities(df: DataFrame, temperature: Column | float) -> DataFrame:
    """Add ``probs``; values are rounded so that ranks do not depend on the last
    bits of an exponential."""
    p = softmax(C("logits"), temperature)
    return df.withColumn("probs", F.transform(p, lambda x: rnd(x, PROB_PLACES)))


def class_ranks(probs: Column) -> Column:
    """1-based rank of each class by falling probability, ties by class."""
    return F.transform(
        probs,
        lambda p, i: F.lit(1)
        + F.size(F.filter(F.transform(probs, lambda q, j: (q > p) | ((q == p) & (j < i))), lambda hit: hit)),
    )


def class_scores(probs: Column, lam: float = 0.01, k_reg: int = 1) -> Column:
    """Conformity score of every class: 1 - p + lambda * max(rank - k, 0)."""
    ranks = class_ranks(probs)
    return F.zip_with(
        probs, ranks, lambda p, r: F.lit(1.0) - p + F.lit(lam) * F.greatest(r - k_reg, F.lit(0)).cast("double")
    )


def with_scores(df: DataFrame, lam: float = 0.01, k_reg: int = 1) -> DataFrame:
    """Add ``class_scores`` and ``score`` (that of the label)."""
    s = df.withColumn("class_scores", class_scores(C("probs"), lam, k_reg))
    return s.withColumn("score", F.get("class_scores", C("label").cast("int")))


def fit_quantiles(df: DataFrame, by: Sequence[str], *, alpha: float = 0.1, min_class_rows: int = 20) -> DataFrame:
    """Per (group, label) the k-th smallest score, k = clamp(ceil((n+1)(1-alpha)), 1, n);
    small and absent classes use the pooled score of the group."""
    k = F.greatest(F.lit(1), F.least(C("n_values"), F.ceil((C("n_values") + 1) * F.lit(1.0 - alpha))))
    own = order_statistic(df, [*by, "label"], "score", k, "q")
    pooled = order_statistic(df, by, "score", k, "pooled").drop("n_values")
    width = df.groupBy(*by).agg(F.max(F.size("probs")).alias("n_classes"))
    grid = pooled.join(width, list(by)).select(
        *by, "pooled", F.explode(F.sequence(F.lit(0).cast("long"), C("n_classes").cast("long") - 1)).alias("label")
    )
    j = grid.join(own, [*by, "label"], "left")
    q = F.when(C("n_values") >= min_class_rows, C("q")).otherwise(C("pooled"))
    return j.select(*by, "label", q.alias("q_hat"))


def with_sets(df: DataFrame, quantiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the prediction set ``members`` (class indexes), ``lower_bound`` (its
    smallest probability, 0 if empty) and ``covered``."""
    packed = quantiles.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("label", "q_hat"))), lambda s: s["q_hat"]).alias("__q")
    )
    j = df.join(packed, list(by))
    inside = F.zip_with("class_scores", "__q", lambda s, q: s <= q)
    members = F.filter(F.sequence(F.lit(0), F.size("probs") - 1), lambda c: F.get(C("__in"), c))
    j = j.withColumn("__in", inside).withColumn("members", members)
    low = F.array_min(F.transform("members", lambda c: F.get(C("probs"), c)))
    return (
        j.withColumn("lower_bound", F.coalesce(low, F.lit(0.0)))
        .withColumn("covered", F.array_contains("members", C("label").cast("int")))
        .drop("__q", "__in")
    )


def ece(df: DataFrame, by: Sequence[str], *, confidence: str, correct: Column, tie: str, bins: int = 15) -> DataFrame:
    """Equal-mass calibration error per group: rows ranked by confidence, bins of
    floor(n / bins) rows, the last bin takes the rest."""
    src = df.withColumn("__ok", correct.cast("double"))
    sizes = src.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    ranked = row_ranks(src.select(*by, confidence, tie, "__ok"), by, confidence, tie, out="__rank").join(sizes, list(by))
    size = F.greatest(F.lit(1), F.floor(C("__n") / bins))
    b = F.least(F.floor((C("__rank") - 1) / size), F.lit(bins - 1))
    binned = ranked.groupBy(*by, b.alias("__bin")).agg(
        F.avg(confidence).alias("__conf"), F.avg("__ok").alias("__acc"), F.count(F.lit(1)).alias("__m"), F.max("__n").alias("__n")
    )
    return binned.groupBy(*by).agg(F.sum(C("__m") / C("__n") * F.abs(C("__conf") - C("__acc"))).alias("ece"))


def top_class(df: DataFrame) -> DataFrame:
    """Add ``confidence`` and ``correct`` of the most probable class."""
    best = F.array_max("probs")
    return df.withColumn("confidence", best).withColumn(
        "correct", F.array_position("probs", best) - 1 == C("label")
    )


def one_vs_rest(df: DataFrame) -> DataFrame:
    """One row per (row, class) with binary confidence and correctness."""
    long = df.select("*", F.posexplode("probs").alias("class", "p"))
    hit = (C("p") > 0.5) == (C("label") == C("class"))
    return long.withColumn("confidence", F.greatest(C("p"), 1 - C("p"))).withColumn("correct", hit)


def brier(probs: Column, label: Column) -> Column:
    """Mean squared error of one row's probabilities."""
    sq = F.transform(probs, lambda p, i: F.pow(p - (i == label.cast("int")).cast("double"), F.lit(2.0)))
    return F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x) / F.size(probs)


def variance_multiplier(var: Column, target: float = 0.05, floor: float = 0.0, ceil: float = 1.0) -> Column:
    raw = F.lit(target) / F.sqrt(F.greatest(var, F.lit(1e-12)))
    return F.when(var.isNotNull(), F.least(F.greatest(raw, F.lit(floor)), F.lit(ceil)))
