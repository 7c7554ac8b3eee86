"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """`stored`, and the folder for `drop_stored`."""
    ensure_checkpoint_dir(df.sparkSession)
    folder = df.sparkSession.sparkContext.getCheckpointDir()
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared checkpoint folder and read it back.

    The lineage is cut, readers prune columns, and a lost executor loses nothing.
    """
    return stored_at(df)[0]


def drop_stored(spark: SparkSession, path: str) -> None:
    """Delete a table of `stored_at` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _is_scan(docs: DataFrame) -> bool:
    """Whether `docs` is a Parquet scan with nothing but filters and projections on it, so that each row is one row of a file."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Filter", "Project", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        return docs.select(docs.metadataColumn("_metadata")["row_index"]).columns == ["_metadata.row_index"]
    except AnalysisException:
        return False


def with_row_id(docs: DataFrame, name: str = "rid") -> DataFrame:
    """Add a row number that tells repeated rows apart: the number of the row's file, and its place in the file.

    It does not depend on how a scan is split, so a row keeps its number whatever executors come or go between two scans.
    Anything but a scan is stored first; the result must then be used for every later scan.
    """
    docs = docs if _is_scan(docs) else stored(docs)
    path, at, file = (fresh([*docs.columns, name], x) for x in ("path", "at", "file"))
    meta = docs.metadataColumn("_metadata")
    files = docs.select(meta["file_path"].alias(path)).distinct().coalesce(1).sortWithinPartitions(path)
    files = stored(files.withColumn(file, F.monotonically_increasing_id()))
    placed = docs.select(*[docs[f"`{c}`"] for c in docs.columns], meta["file_path"].alias(path), meta["row_index"].alias(at))
    number = F.when(F.col(file).isNull(), F.raise_error(F.lit("a file came up after the scan began")).cast("long")).otherwise(F.shiftleft(file, 33) + F.col(at))
    return placed.join(F.broadcast(files), path, "left").select(*[f"`{c}`" for c in docs.columns], number.alias(name))


def texts_of(rows: DataFrame, name: str = "rid") -> DataFrame:
    """(rid, doc_id, text) of numbered rows; a null text counts as empty."""
    return rows.select(F.col(name).alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text) of every row; a null text counts as empty."""
    return texts_of(with_row_id(docs.select("doc_id", "text")))


def slices(batches: Iterable[pa.RecordBatch], *columns: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices whose strings or binaries of `columns` have about `size` bytes, one row at least:
    what a worker makes of them stays small whatever the size of a batch."""
    for batch in batches:
        upto = np.zeros(len(batch) + 1, dtype=np.int64)
        for c in columns:
            upto[1:] += np.cumsum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def fresh(columns: Iterable[str], name: str) -> str:
    """`name`, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(col: Column, folds: int) -> Column:
    """crc32 of the value as text, modulo `folds`."""
    return F.crc32(col.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, rows: int):
    """At most `rows` labelled documents outside the held-out fold, the same ones in every run.

    The bound makes the sample fit the driver and the id list fit a broadcast. Returns a pandas frame
    (doc_id, text, target); labels that are null or whose document is missing give no row, and of several
    labels of a document the largest counts.
    """
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("target"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.toPandas().sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)


def doc_id_type(docs: DataFrame) -> T.DataType:
    return docs.schema["doc_id"].dataType
