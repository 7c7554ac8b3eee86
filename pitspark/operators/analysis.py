"""Model-agnostic analysis of a fitted Spark ML model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.operators.chunked import SeriesKey, row_positions

C = F.col


def log_loss(scored: DataFrame, by: Sequence[str], *, label: str, probability: str = "probability") -> DataFrame:
    """Mean negative log likelihood and accuracy per group."""
    from pyspark.ml.functions import vector_to_array

    p = F.get(vector_to_array(probability), C(label).cast("int"))
    loss = -F.ln(F.greatest(p, F.lit(1e-15)))
    hit = (C("prediction") == C(label)).cast("double")
    return scored.groupBy(*by).agg(F.avg(loss).alias("loss"), F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def _filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every row with its features as numbers; a missing one counts as 0, which
    is also the value of an ablated one."""
    return df.withColumns({f: F.coalesce(C(f).cast("double"), F.lit(0.0)) for f in features})


def permutation_importance(
    df: DataFrame, model: PipelineModel, *, features: Sequence[str], label: str, row_id: str, repeats: int = 3, seed: int = 42
) -> DataFrame:
    """Loss increase when one feature is shuffled: mean and deviation over
    repeats. All (feature, repeat) shuffles run as one job: a row's partner is
    the row with its rank in a seeded hash order."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for f in features for r in range(repeats)]
    )
    base = _filled(df, features)
    long = base.select("*", F.explode(pairs).alias("__p")).select("*", "__p.*").drop("__p")
    cells = F.create_map(*[x for f in features for x in (F.lit(f), C(f).cast("double"))])
    draws = long.select(
        "feature",
        "repeat",
        row_id,
        F.xxhash64(row_id, "feature", "repeat", F.lit(seed)).alias("__h"),
        F.element_at(cells, C("feature")).alias("__value"),
    )
    # Hash values are uniform, so their high bits cut the order evenly.
    key = SeriesKey(("feature", "repeat"), "__h", (row_id,))
    donors = row_positions(draws, key, pos="__i", chunk=F.shiftright("__h", 56)).select(
        "feature", "repeat", "__i", "__value"
    )
    takers = row_positions(
        long, SeriesKey(("feature", "repeat"), row_id), pos="__i", chunk=F.floor(C(row_id) / 100_000)
    )
    mixed = takers.join(donors, ["feature", "repeat", "__i"])
    swapped = mixed.withColumns(
        {f: F.when(C("feature") == f, C("__value")).otherwise(C(f).cast("double")) for f in features}
    )
    shuffled = log_loss(model.transform(swapped), ["feature", "repeat"], label=label)
    plain = log_loss(model.transform(base), [], label=label).select(C("loss").alias("base_loss"))
    delta = shuffled.withColumn("__one", F.lit(1)).join(F.broadcast(plain.withColumn("__one", F.lit(1))), "__one")
    return delta.groupBy("feature").agg(
        F.avg(C("loss") - C("base_loss")).alias("delta_mean"),
        F.stddev_pop(C("loss") - C("base_loss")).alias("delta_std"),
        F.first("base_loss").alias("base_loss"),
    )


def group_ablation(
    df: DataFrame, model: PipelineModel, *, groups: Mapping[str, Sequence[str]], label: str, bucket: str
) -> DataFrame:
    """Loss per ablated feature group and bucket; ``none`` is the intact model.
    The rows are exploded over the ablations and scored once."""
    names = ["none", *groups]
    features = sorted({f for fs in groups.values() for f in fs})
    long = _filled(df, features).withColumn("ablation", F.explode(F.array(*[F.lit(n) for n in names])))
    zeroed = {}
    for f in features:
        hit = C("ablation").isin([n for n, fs in groups.items() if f in fs])
        zeroed[f] = F.when(hit, F.lit(0.0)).otherwise(C(f).cast("double"))
    scored = model.transform(long.withColumns(zeroed))
    both = scored.withColumn("__b", F.explode(F.array(C(bucket).cast("string"), F.lit("both"))))
    return log_loss(both, ["ablation", "__b"], label=label).withColumnRenamed("__b", "bucket")
