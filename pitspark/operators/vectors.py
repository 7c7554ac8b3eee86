"""Vector aggregates: class anchors, cosine features, cohesion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions.mathfn import cosine, dot, l2_norm, ratio
from pitspark.functions.timefn import floor_time
from pitspark.operators.lookups import attach_lookup


def anchor_vectors(vectors: DataFrame, *, by: str, vec: str) -> DataFrame:
    """L2-normalised mean vector per class (by, anchor).

    Dimensions are averaged as (class, dim) groups with map-side partials, so a
    class of any size never meets in one task as whole vectors.
    """
    means = (
        vectors.select(by, F.posexplode(vec).alias("dim", "v"))
        .groupBy(by, "dim")
        .agg(F.avg("v").alias("m"))
    )
    packed = means.groupBy(by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean")
    )
    norm = l2_norm(F.col("mean"))
    return packed.select(by, F.transform("mean", lambda x: x / norm).alias("anchor"))


def anchor_cosines(vectors: DataFrame, anchors: DataFrame, *, id: str, vec: str, label: str = "label") -> DataFrame:
    """(id, class, cosine) of every vector with every anchor. Anchors are a
    bounded lookup attached as one array."""
    rows = attach_lookup(vectors.select(id, vec), anchors.select(label, "anchor"), "__a")
    return rows.select(id, vec, F.explode("__a").alias("a")).select(
        id, F.col(f"a.{label}").alias("class"), cosine(F.col(vec), F.col("a.anchor")).alias("cosine")
    )


def bar_anchor_stats(
    bars: DataFrame, cosines: DataFrame, *, at: str, time: str, seconds: int, lookback: int, top: int = 5
) -> DataFrame:
    """Per grid time and class: count, mean, max and mean of the ``top`` highest
    cosines of the articles visible in the ``lookback`` grid steps before it.

    Articles are first reduced to mergeable partials per grid step; a grid time
    merges ``lookback`` partials, so no article is paired with the bars that
    see it.
    """
    step = floor_time(F.col(time), seconds)
    src = cosines.withColumn("__g", step)
    sums = src.groupBy("__g", "class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cosine").alias("s"), F.max("cosine").alias("m")
    )
    rank = Window.partitionBy("__g", "class").orderBy(F.col("cosine").desc())
    best = (
        src.withColumn("__r", F.row_number().over(rank))
        .filter(F.col("__r") <= top)
        .groupBy("__g", "class")
        .agg(F.collect_list("cosine").alias("best"))
    )
    parts = sums.join(best, ["__g", "class"])
    reach = F.sequence(F.lit(1), F.lit(lookback))
    later = parts.select("*", F.explode(reach).alias("__k"))
    micro = F.lit(seconds) * F.col("__k")
    later = later.withColumn(at, F.col("__g") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micro.cast("decimal(18,6)")))
    merged = later.groupBy(at, "class").agg(
        F.sum("n").alias("n_visible"),
        (F.sum("s") / F.sum("n")).alias("mean_cosine"),
        F.max("m").alias("max_cosine"),
        F.slice(F.reverse(F.sort_array(F.flatten(F.collect_list("best")))), 1, top).alias("__best"),
    )
    merged = merged.withColumn(
        "top_cosine", F.aggregate("__best", F.lit(0.0), lambda acc, x: acc + x) / F.size("__best")
    ).drop("__best")
    out = bars.join(merged, at, "left")
    return out.withColumn("n_visible", F.coalesce("n_visible", F.lit(0))).withColumn("has_news", F.col("n_visible") > 0)


def cohesion(vectors: DataFrame, anchors: DataFrame, *, by: str, vec: str) -> DataFrame:
    """How tight each class is, without comparing its members pairwise.

    The mean pairwise cosine follows from the sum of the unit vectors:
    (|sum|^2 - n) / (n (n - 1)). ``min_to_anchor`` is the worst cosine to the
    class anchor; by the angle sum no pair is below 2 c^2 - 1 (for c >= 0),
    reported as ``pair_floor``.
    """
    unit = vectors.select(by, vec, l2_norm(F.col(vec)).alias("__n")).select(
        by, F.transform(vec, lambda x: x / F.col("__n")).alias("u")
    )
    dims = unit.select(by, F.posexplode("u").alias("dim", "v")).groupBy(by, "dim").agg(F.sum("v").alias("s"))
    sq = dims.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    near = (
        unit.join(anchors.select(by, "anchor"), by)
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"), F.min(dot(F.col("u"), F.col("anchor"))).alias("min_to_anchor"))
    )
    j = sq.join(near, by)
    n, c = F.col("n"), F.col("min_to_anchor")
    return j.select(
        by, "n", ratio(F.col("sq") - n, n * (n - 1)).alias("mean_pairwise"), "min_to_anchor",
        F.when(c >= 0, 2 * c * c - 1).otherwise(F.lit(-1.0)).alias("pair_floor"),
    )


def _of_class(lookup: str, by: str, field: str) -> Column:
    """Field of the row's own class in an attached lookup."""
    mine = F.filter(lookup, lambda a: a[by].eqNullSafe(F.col(by)))
    return F.get(mine, F.lit(0))[field]


def _pair_minimum(by: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["__first"].to_numpy()
        same = bool(pdf["__same"].iloc[0])
        left = pdf if same else pdf[first]
        right = pdf if same else pdf[~first]
        if not len(left) or not len(right):
            return pd.DataFrame({by: pdf[by].iloc[:0], "best": np.empty(0), "compared": np.empty(0, dtype=np.int64)})
        a, b = np.stack(left["u"].to_list()), np.stack(right["u"].to_list())
        dots = a @ b.T
        n = dots.size
        if same:
            np.fill_diagonal(dots, np.inf)
            n = len(a) * (len(a) - 1) // 2
        return pd.DataFrame({by: [pdf[by].iloc[0]], "best": [float(dots.min())], "compared": [n]})

    return run


def min_pairwise(
    vectors: DataFrame, anchors: DataFrame, *, by: str, id: str, vec: str, block: int = 2048, bins: int = 720
) -> DataFrame:
    """Exact smallest cosine between two members of each class: (by, n, compared,
    min_pairwise); NULL for a class of one. Missing and zero vectors are left out.

    Angles obey the triangle inequality, so two members are at most as far apart
    as the sum of their angles to a pivot. Pivots are the class anchor and the
    two ends of a sweep (the member farthest from the anchor, then the one
    farthest from that). The sweep gives an angle that is reached; only members,
    and then only blocks of members alike in their angle, whose bound passes it
    are compared, as matrix products of two blocks of about ``block`` rows.
    ``compared`` counts these pairs. The cost grows with the square of what the
    bounds leave, spread over block pairs: tight classes with few outlying
    members need few, vectors near noise need most.
    """
    unit = vectors.select(by, id, vec, l2_norm(F.col(vec)).alias("__n")).filter(F.col("__n") > 0).select(
        by, id, F.transform(vec, lambda x: x / F.col("__n")).alias("u")
    )

    def angle(a: Column, b: Column) -> Column:
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))

    rows = attach_lookup(unit, anchors.select(by, "anchor"), "__a")
    rows = rows.withColumn("t0", angle(F.col("u"), _of_class("__a", by, "anchor"))).drop("__a")
    ends = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max_by("u", F.struct("t0", id)).alias("e"))
    rows = attach_lookup(rows, ends.select(by, "e"), "__e")
    rows = rows.withColumn("t1", angle(F.col("u"), _of_class("__e", by, "e"))).drop("__e")
    far = rows.groupBy(by).agg(F.max_by("u", F.struct("t1", id)).alias("f"))
    rows = attach_lookup(rows, far, "__f")
    rows = rows.withColumn("t2", angle(F.col("u"), _of_class("__f", by, "f"))).drop("__f")
    tops = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), *[F.max(f"t{k}").alias(f"m{k}") for k in range(3)]
    ).withColumn("reached", F.greatest("m1", "m2"))
    rows = attach_lookup(rows, tops, "__t")
    slack = 1e-9
    alive = F.lit(True)
    for k in range(3):
        alive = alive & (F.col(f"t{k}") + _of_class("__t", by, f"m{k}") + slack >= _of_class("__t", by, "reached"))
    width = np.pi / bins
    kept = rows.filter(alive).drop("__t").withColumn("bin", F.floor(F.col("t0") / width).cast("int"))
    fine = kept.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("m"), F.max("t0").alias("top"), *[F.max(f"t{k}").alias(f"b{k}") for k in (1, 2)])
    # Neighbouring bins make a block; at most ``bins`` rows a class pass this window.
    before = Window.partitionBy(by).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("grp", F.floor(F.coalesce(F.sum("m").over(before), F.lit(0)) / block).cast("int"))
    sizes = fine.groupBy(by, "grp").agg(
        F.ceil(F.sum("m") / block).cast("int").alias("subs"), *[F.max(c).alias(c) for c in ("top", "b1", "b2")],
        F.min("bin").alias("lo"), F.max("bin").alias("hi"),
    )
    sizes = sizes.withColumnRenamed("grp", "bin")
    blocks = sizes.select(by, "bin", "subs", "top", "b1", "b2", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    blocks = attach_lookup(blocks, tops.select(by, "reached"), "__t").withColumn("reached", _of_class("__t", by, "reached")).drop("__t")
    l, r = blocks.alias("l"), blocks.alias("r")
    bound = F.least(*[F.col(f"l.{c}") + F.col(f"r.{c}") for c in ("top", "b1", "b2")])
    order = F.struct("l.bin", "l.sub") <= F.struct("r.bin", "r.sub")
    pairs = l.join(r, F.col(f"l.{by}").eqNullSafe(F.col(f"r.{by}")) & order & (bound + slack >= F.col("l.reached"))).select(
        F.col(f"l.{by}").alias("c"),
        F.struct(F.col("l.bin").alias("lb"), F.col("l.sub").alias("ls"), F.col("r.bin").alias("rb"), F.col("r.sub").alias("rs")).alias("pair"),
    )
    same = (F.col("pair.lb") == F.col("pair.rb")) & (F.col("pair.ls") == F.col("pair.rs"))
    ways = pairs.withColumn("__same", same).select(
        "c", "pair", "__same",
        F.explode(
            F.when(same, F.array(F.struct(F.lit(True).alias("first"), F.col("pair.lb").alias("b"), F.col("pair.ls").alias("s")))).otherwise(
                F.array(
                    F.struct(F.lit(True).alias("first"), F.col("pair.lb").alias("b"), F.col("pair.ls").alias("s")),
                    F.struct(F.lit(False).alias("first"), F.col("pair.rb").alias("b"), F.col("pair.rs").alias("s")),
                )
            )
        ).alias("w"),
    )
    where = sizes.select(
        F.col(by).alias("c0"), F.col("bin").alias("grp"), "subs", F.explode(F.sequence("lo", "hi")).alias("bin0")
    )
    own = kept.join(where, F.col(by).eqNullSafe(F.col("c0")) & (F.col("bin") == F.col("bin0"))).select(
        by, id, "u", F.col("grp").alias("bin"), F.pmod(F.xxhash64(id), F.col("subs")).cast("int").alias("sub")
    )
    sent = own.join(
        ways, F.col(by).eqNullSafe(F.col("c")) & (F.col("bin") == F.col("w.b")) & (F.col("sub") == F.col("w.s"))
    ).select(by, "u", F.col("pair.lb").alias("lb"), F.col("pair.ls").alias("ls"), F.col("pair.rb").alias("rb"), F.col("pair.rs").alias("rs"), F.col("w.first").alias("__first"), "__same")
    schema = f"`{by}` {vectors.schema[by].dataType.simpleString()}, best double, compared long"
    found = sent.groupBy(by, "lb", "ls", "rb", "rs").applyInPandas(_pair_minimum(by), schema)
    best = found.groupBy(by).agg(F.min("best").alias("best"), F.sum("compared").alias("compared"))
    out = tops.alias("t").join(best.alias("b"), F.col(f"t.{by}").eqNullSafe(F.col(f"b.{by}")), "left")
    finite = F.when(F.col("best") < 2, F.col("best"))
    return out.select(F.col(f"t.{by}").alias(by), "n", F.coalesce("compared", F.lit(0)).alias("compared"), finite.alias("min_pairwise"))
