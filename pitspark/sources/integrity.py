"""Integrity of files of any size: byte ranges hashed by many tasks.

A Python data source lists the files and cuts them into ranges of whole blocks.
Every task reads its ranges block by block (constant memory) through pyarrow's
file systems, so local, HDFS and object-store paths work alike. The hashes of a
file form a tree: blocks, ranges, spans of ranges, file. No row holds a file,
and a manifest that keeps the block hashes shows which bytes have changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 4 << 20
RANGE_BLOCKS = 64
SPAN_RANGES = 1024


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def list_files(pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files a glob, a folder or a path names, sorted. Names
    that start with ``_`` or ``.`` or end with ``.tmp`` or ``.bak`` are skipped."""
    from pyarrow import fs

    parts = pattern.split("/")
    wild = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), None)
    system, base = _open(pattern if wild is None else "/".join(parts[:wild]) or "/")
    root = system.get_file_info(base)
    if root.type == fs.FileType.File:
        found = [root]
    elif root.type == fs.FileType.NotFound:
        return []
    else:
        deep = wild is None or wild + 1 < len(parts)
        found = system.get_file_info(fs.FileSelector(base, recursive=deep))
    tail = None if wild is None else parts[wild:]

    def chosen(path: str) -> bool:
        rel = path[len(base) :].strip("/").split("/")
        name = path.rsplit("/", 1)[-1]
        if name.startswith(("_", ".")) or name.endswith((".tmp", ".bak")):
            return False
        return tail is None or (len(rel) == len(tail) and all(map(fnmatchcase, rel, tail)))

    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and chosen(f.path))


@dataclass
class Ranges(InputPartition):
    """(path, size, range number) of the ranges one task reads."""

    items: list[tuple[str, int, int]]


class _RangeReader(DataSourceReader):
    def __init__(self, pattern: str, block: int, range_blocks: int):
        self.pattern, self.block, self.width = pattern, block, block * range_blocks

    def partitions(self) -> Sequence[InputPartition]:
        out: list[Ranges] = []
        held = self.width
        for path, size in list_files(self.pattern):
            for k in range(max(1, -(-size // self.width))):
                take = min(self.width, size - k * self.width)
                if held + take > self.width:  # small files share a task
                    out.append(Ranges([]))
                    held = 0
                out[-1].items.append((path, size, k))
                held += max(take, 1)
        return out or [Ranges([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, size, k in partition.items:
            system, name = _open(self.pattern)[0], path
            leaves, left = [], min(self.width, size - k * self.width)
            with system.open_input_file(name) as f:
                f.seek(k * self.width)
                while left > 0 or not leaves:
                    data = f.read(min(self.block, left))
                    leaves.append(hashlib.sha256(data).hexdigest())
                    left -= self.block
            yield path, size, k, leaves


class FileRanges(DataSource):
    """Rows (path, size, range, leaves): block hashes of each byte range."""

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return "path string, size long, `range` long, leaves array<string>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RangeReader(
            self.options["path"], int(self.options.get("block", BLOCK)), int(self.options.get("rangeBlocks", RANGE_BLOCKS))
        )


def file_ranges(spark: SparkSession, pattern: str, *, block: int = BLOCK, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """Block hashes of every range of the files; a file of any size is read by
    many tasks of ``block * range_blocks`` bytes at most."""
    spark.dataSource.register(FileRanges)
    reader = spark.read.format("file_ranges").option("block", block).option("rangeBlocks", range_blocks)
    return reader.load(pattern)


def _node(kind: str, hashes: F.Column | str) -> F.Column:
    return F.sha2(F.concat(F.lit(f"{kind}:"), F.concat_ws("", hashes)), 256)


def tree_manifest(ranges: DataFrame) -> DataFrame:
    """(path, size, n_blocks, sha256) with the root of the hash tree. A group
    holds at most 1,024 ranges, then the spans of one file."""
    nodes = ranges.select(
        "path", "size", "range", F.size("leaves").cast("long").alias("n"), _node("range", "leaves").alias("h"),
        F.floor(F.col("range") / SPAN_RANGES).alias("span"),
    )

    def ordered(index: str) -> F.Column:
        return F.transform(F.sort_array(F.collect_list(F.struct(index, "h"))), lambda s: s["h"])

    spans = nodes.groupBy("path", "size", "span").agg(F.sum("n").alias("n"), _node("span", ordered("range")).alias("h"))
    files = spans.groupBy("path", "size").agg(F.sum("n").alias("n_blocks"), ordered("span").alias("hs"))
    return files.select("path", "size", "n_blocks", _node("file", F.concat(F.array(F.col("size").cast("string")), "hs")).alias("sha256"))


def changed_blocks(declared: DataFrame, actual: DataFrame, *, block: int = BLOCK, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """(path, first_byte, state) of the blocks in which two sets of ranges
    differ: changed, missing (declared only) or unexpected."""
    j = declared.select("path", "range", F.col("leaves").alias("want")).join(
        actual.select("path", "range", F.col("leaves").alias("have")), ["path", "range"], "outer"
    )
    same = F.col("want").isNotNull() & F.col("have").isNotNull() & (F.col("want") == F.col("have"))
    both = F.explode(F.arrays_zip(F.coalesce("want", F.array()), F.coalesce("have", F.array()), F.sequence(F.lit(0), F.lit(range_blocks - 1)).alias("at")))
    rows = j.filter(~same).select("path", "range", both.alias("b")).select("path", "range", F.col("b.*"))
    want, have = [c for c in rows.columns if c not in ("path", "range", "at")]
    state = (
        F.when(F.col(want).isNull() & F.col(have).isNotNull(), "unexpected")
        .when(F.col(have).isNull() & F.col(want).isNotNull(), "missing")
        .when(F.col(want) != F.col(have), "changed")
    )
    first = (F.col("range") * range_blocks + F.col("at")) * F.lit(block).cast("long")
    return rows.select("path", first.alias("first_byte"), state.alias("state")).filter(F.col("state").isNotNull())


def verify_manifest(declared: DataFrame, actual: DataFrame, require: Sequence[str] = ()) -> DataFrame:
    """(path, state) of files that are missing, unexpected, changed or required
    but not declared; empty means intact."""
    d = declared.select("path", F.col("size").alias("want_size"), F.col("sha256").alias("want"))
    j = d.join(actual.select("path", "size", "sha256"), "path", "outer")
    state = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("want").isNull(), "unexpected")
        .when((F.col("sha256") != F.col("want")) | (F.col("size") != F.col("want_size")), "changed")
    )
    bad = j.select("path", state.alias("state")).filter(F.col("state").isNotNull())
    if require:
        wanted = declared.sparkSession.createDataFrame([(p,) for p in require], "path string")
        bad = bad.unionByName(wanted.join(declared, "path", "left_anti").select("path", F.lit("undeclared").alias("state")))
    return bad


def check_intact(declared: DataFrame, actual: DataFrame, require: Sequence[str] = ()) -> None:
    """Raise ValueError that names up to twenty faulty files."""
    bad = verify_manifest(declared, actual, require).orderBy("path").limit(20).collect()
    if bad:
        raise ValueError("files differ from their manifest: " + ", ".join(f"{r['path']} ({r['state']})" for r in bad))
