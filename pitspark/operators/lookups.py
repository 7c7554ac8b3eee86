"""Small tables attached to every row, with a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A class lookup attached to every row must stay a lookup.
MAX_CLASSES = 4096


def attach_lookup(df: DataFrame, lookup: DataFrame, name: str, limit: int = MAX_CLASSES) -> DataFrame:
    """Attach a small table to every row as one array column.

    The lookup is reduced to a single row first; more than ``limit`` entries
    fail the job instead of silently growing the broadcast.
    """
    packed = lookup.agg(F.sort_array(F.collect_list(F.struct(*lookup.columns))).alias(name))
    size = F.size(name)
    checked = packed.select(
        F.when(size <= limit, F.col(name))
        .otherwise(F.raise_error(F.lit(f"lookup {name} exceeds {limit} entries")))
        .alias(name),
        F.lit(1).alias("__one"),
    )
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(checked), "__one", "left").drop("__one")
