"""Fingerprints, snapshot metadata and content-addressed writes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.sources.integrity import file_ranges, tree_manifest, verify_manifest  # noqa: F401


def _portable(field: T.StructField) -> Column:
    """Text form of a value that other engines can reproduce."""
    c = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        text = F.round(c * 1_000_000).cast("decimal(38,0)").cast("string")
    elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        text = F.unix_micros(c.cast("timestamp")).cast("string")
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("\\N"))


def fingerprint(df: DataFrame, *, portable: bool = False) -> DataFrame:
    """One row (n_rows, hash_sum, hash_xor, digest) identifying the content of a
    table. It does not depend on row order or partitioning and changes with
    any value, column name or column type.

    Row hashes are combined by sum and xor, so the job is one map-side
    aggregate. ``portable`` hashes a text form (doubles to six places) instead
    of the native encoding.
    """
    if portable:
        text = F.concat_ws("|", *[_portable(f) for f in df.schema])
        h = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    else:
        h = F.xxhash64(*df.columns)
    exact = F.sum(h.cast("decimal(38,0)")).cast("string")
    agg = df.agg(
        F.count(F.lit(1)).alias("n_rows"), exact.alias("hash_sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor")
    )
    shape = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    digest = F.sha2(F.concat_ws("/", F.lit(shape), "n_rows", "hash_sum", F.col("hash_xor").cast("string")), 256)
    return agg.withColumn("digest", F.substring(digest, 1, 16))


def snapshot_meta(df: DataFrame, time: str, sources: Sequence[str] = ()) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.min(time).alias("first_ts"),
        F.max(time).alias("last_ts"),
    ).withColumn("sources", F.lit("|".join(sources)))


def write_snapshot(df: DataFrame, root: str, version: str, *, time: str, overwrite: bool = False) -> str:
    """Write a table under a path that contains its fingerprint, with a metadata
    table beside it. An existing snapshot is an error unless ``overwrite``."""
    digest = fingerprint(df).first()["digest"]
    path = f"{root}/{version}_{digest}"
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    snapshot_meta(df, time).withColumn("digest", F.lit(digest)).write.mode(mode).json(f"{path}.meta")
    return path


class PublishConflict(RuntimeError):
    """Another writer has moved the pointer since this one has read it."""


def _fs(spark: SparkSession, path: str):
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark._jsc.hadoopConfiguration()), hp


def _create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content, or return False where it exists:
    a temporary file is renamed without overwriting, in one step. On a local
    disk, where a rename replaces, the step is a hard link."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, where = _fs(spark, tmp)
    out = fs.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            try:
                os.link(where.toUri().getPath(), _fs(spark, path)[1].toUri().getPath())
                return True
            except FileExistsError:
                return False
        jvm = spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
        plain = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(where, jvm.org.apache.hadoop.fs.Path(path), plain)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
    finally:
        fs.delete(where, False)


def pointer(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(number, version) of the newest pointer; (0, None) before the first."""
    fs, where = _fs(spark, f"{root}/_current")
    if not fs.exists(where):
        return 0, None
    found = [s.getPath() for s in fs.listStatus(where)]
    found = [p for p in found if p.getName().isdigit()]
    if not found:
        return 0, None
    last = max(found, key=lambda p: int(p.getName()))
    stream = fs.open(last)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return int(last.getName()), text


def _move_pointer(spark: SparkSession, root: str, base: int, version: str) -> int:
    fs, where = _fs(spark, f"{root}/_current")
    fs.mkdirs(where)
    if pointer(spark, root)[0] != base or not _create_once(spark, f"{root}/_current/{base + 1:012d}", version):
        raise PublishConflict(f"{root}: the pointer has moved on from {base}")
    return base + 1


def publish(df: DataFrame, root: str, version: str, *, base: int | None = None) -> int:
    """Make a new version current: write it completely, then move the pointer
    from ``base`` (default: where it stands now) to the next number.

    The pointer is a row of numbered files, each created once; of two writers
    that start from the same number one gets a ``PublishConflict``. After a
    failed write or a lost race the pointer stands and the new folder is removed.
    """
    spark = df.sparkSession
    if base is None:
        base = pointer(spark, root)[0]
    path = f"{root}/{version}"
    fs, where = _fs(spark, path)
    if fs.exists(where):
        raise FileExistsError(f"version exists: {path}")
    try:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        return _move_pointer(spark, root, base, version)
    except Exception:
        fs.delete(where, True)
        raise


def roll_back(spark: SparkSession, root: str, *, to: int) -> int:
    """Make the version of an earlier pointer current again, as a new pointer."""
    fs, where = _fs(spark, f"{root}/_current/{to:012d}")
    stream = fs.open(where)
    try:
        version = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return _move_pointer(spark, root, pointer(spark, root)[0], version)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = pointer(spark, root)[1]
    if version is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(f"{root}/{version}")


def integrity_manifest(spark: SparkSession, glob: str) -> DataFrame:
    """(path, size, n_blocks, sha256) of files of any size, see ``integrity``."""
    return tree_manifest(file_ranges(spark, glob))
