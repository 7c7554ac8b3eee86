"""Declared table contracts: columns, types, nullability and primary key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "ts": T.TimestampNTZType()}


@dataclass(frozen=True)
class Contract:
    """What a stored table must look like: its schema (a field that is not
    nullable must be filled) and the columns that no two rows share."""

    name: str
    schema: T.StructType
    key: tuple[str, ...] = ()

    @staticmethod
    def of(name: str, spec: str, key: Sequence[str]) -> Contract:
        """From 'column type' pairs; a '?' behind the type allows nulls."""
        pairs = [p.split() for p in spec.split(",")]
        fields = [T.StructField(c, _TYPES[t.rstrip("?")], t.endswith("?")) for c, t in pairs]
        return Contract(name, T.StructType(fields), tuple(key))

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)


# The two names of the clock columns. A row is published at the
# first and may be used from the second on.
RELEASED, VISIBLE = "release_ts", "t_visible"
_CLOCK = f"{RELEASED} ts, {VISIBLE} ts"

#: Contracts of the tables that this library itself builds.
CONTRACTS: dict[str, Contract] = {
    c.name: c
    for c in (
        Contract.of("bars", f"symbol string, bar_open ts, bar_close ts, open double, high double, low double, close double, volume long, {_CLOCK}", ["symbol", "bar_open"]),
        Contract.of("vintages", f"series_id string, date ts, realtime_start ts, value double?, {_CLOCK}", ["series_id", "date", "realtime_start"]),
        Contract.of("articles", f"article_id long, source string, created_at ts, body string?, {_CLOCK}", ["article_id"]),
    )
}


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_or_empty(spark: SparkSession, contract: Contract, *paths: str) -> DataFrame:
    """Parquet scan of the paths that exist, with the declared schema; an empty
    table if none does."""
    there = [p for p in paths if _exists(spark, p)]
    return spark.read.schema(contract.schema).parquet(*there) if there else contract.empty(spark)


def shape_violations(df: DataFrame, contract: Contract, *, allow_extra: bool = True) -> list[str]:
    """Missing, extra and mistyped columns; no job is run."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in contract.schema}
    out = [f"missing column {c}" for c in want if c not in have]
    out += [f"column {c} is {have[c].simpleString()}, expected {t.simpleString()}" for c, t in want.items() if c in have and have[c] != t]
    if not allow_extra:
        out += [f"extra column {n}" for n in have if n not in want]
    return out


def value_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, n) for nulls in required columns and for release after
    visibility, from one aggregate pass; only broken rules are returned."""
    rules = {
        f"null {f.name}": F.col(f.name).isNull() for f in contract.schema if not f.nullable and f.name in df.columns
    }
    if {RELEASED, VISIBLE} <= set(df.columns):
        rules[f"{RELEASED} > {VISIBLE}"] = F.col(RELEASED) > F.col(VISIBLE)
    counts = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])
    return counts.unpivot([], [f"`{r}`" for r in rules], "rule", "n").filter("n > 0")


def key_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, n): how many keys of the contract occur more than once; no row if none."""
    twice = df.groupBy(*contract.key).agg(F.count("*").alias("__n")).filter("__n > 1")
    return twice.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(f"repeated key {', '.join(contract.key)}").alias("rule"), "n")


def validate(df: DataFrame, contract: Contract, *, allow_extra: bool = True) -> DataFrame:
    """Return the table unchanged or raise with everything that is wrong."""
    problems = shape_violations(df, contract, allow_extra=allow_extra)
    if not problems:
        problems = [f"{r['rule']}: {r['n']} rows" for r in value_violations(df, contract).collect()]
        if contract.key:
            problems += [f"{r['rule']}: {r['n']} keys" for r in key_violations(df, contract).collect()]
    if problems:
        raise ValueError(f"{contract.name}: " + "; ".join(problems))
    return df


def write_validated(df: DataFrame, contract: Contract, path: str, *, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Validate, then write zstd Parquet (partitioned columns prune scans)."""
    writer = validate(df, contract).write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
