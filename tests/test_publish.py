"""Publishing with a compare-and-swap pointer, and integrity of large files."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pitspark.sources import integrity, snapshot


def test_two_writers_from_one_base(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshot.publish(spark.range(3), root, "v1") == 1
    base = snapshot.pointer(spark, root)[0]
    assert snapshot.publish(spark.range(5), root, "v2", base=base) == 2
    with pytest.raises(snapshot.PublishConflict):
        snapshot.publish(spark.range(7), root, "v3", base=base)
    assert snapshot.read_current(spark, root).count() == 5
    assert not (tmp_path / "t" / "v3").exists()


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    won, lost = [], []

    def work(i):
        try:
            won.append((snapshot.publish(spark.range(i + 1), root, f"w{i}", base=0), i))
        except snapshot.PublishConflict:
            lost.append(i)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 5
    assert snapshot.read_current(spark, root).count() == won[0][1] + 1
    assert not list(Path(root).glob("_current/*.tmp"))


def test_failed_write_and_roll_back(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshot.publish(spark.range(3), root, "v1")
    broken = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).alias("x"))
    with pytest.raises(Exception, match="no"):
        snapshot.publish(broken, root, "v2")
    assert not (tmp_path / "t" / "v2").exists() and snapshot.pointer(spark, root) == (1, "v1")
    snapshot.publish(spark.range(4), root, "v2")
    assert snapshot.roll_back(spark, root, to=1) == 3
    assert snapshot.read_current(spark, root).count() == 3
    with pytest.raises(FileExistsError):
        snapshot.publish(spark.range(1), root, "v2")
    with pytest.raises(FileNotFoundError):
        snapshot.read_current(spark, str(tmp_path / "none"))


def test_three_gigabytes_by_several_tasks(spark, tmp_path):
    big = tmp_path / "big.bin"
    with big.open("wb") as f:
        f.truncate(3 * (1 << 30) + 17)
    (tmp_path / "empty.bin").touch()
    (tmp_path / "small.bin").write_bytes(b"abc")
    (tmp_path / "half.bin.tmp").write_bytes(b"x")
    ranges = integrity.file_ranges(spark, f"{tmp_path}/*.bin*")
    assert ranges.rdd.getNumPartitions() >= 12
    before = ranges.toPandas()
    kept = spark.createDataFrame(before, ranges.schema)
    declared = integrity.tree_manifest(kept)
    sizes = {Path(r.path).name: (r.size, r.n_blocks) for r in declared.collect()}
    assert sizes == {"big.bin": (3 * (1 << 30) + 17, 769), "empty.bin": (0, 1), "small.bin": (3, 1)}
    with big.open("r+b") as f:
        f.seek(5 * (1 << 29) + 3)
        f.write(b"\1")
    (tmp_path / "new.bin").write_bytes(b"n")
    (tmp_path / "small.bin").unlink()
    now = integrity.file_ranges(spark, f"{tmp_path}/*.bin")
    now = spark.createDataFrame(now.toPandas(), now.schema)
    bad = integrity.verify_manifest(declared, integrity.tree_manifest(now), require=[str(big), "other"])
    got = {Path(r.path).name: r.state for r in bad.collect()}
    assert got == {"big.bin": "changed", "new.bin": "unexpected", "small.bin": "missing", "other": "undeclared"}
    where = {(Path(r.path).name, r.first_byte, r.state) for r in integrity.changed_blocks(kept, now).collect()}
    assert where == {("big.bin", 5 * (1 << 29), "changed"), ("new.bin", 0, "unexpected"), ("small.bin", 0, "missing")}
    with pytest.raises(ValueError, match="big.bin .changed"):
        integrity.check_intact(declared, integrity.tree_manifest(now))
    integrity.check_intact(declared, declared)


def test_the_tree_follows_content_not_the_cut_into_tasks(spark, tmp_path):
    for name in ("a.bin", "b.bin"):
        (tmp_path / name).write_bytes(bytes(range(256)) * 41)
    rows = integrity.file_ranges(spark, f"{tmp_path}/*.bin", block=100, range_blocks=4)
    roots = {r.sha256 for r in integrity.tree_manifest(rows).collect()}
    assert len(roots) == 1
    assert rows.agg(F.sum(F.size("leaves"))).first()[0] == 2 * 105
    assert integrity.file_ranges(spark, f"{tmp_path}/*.none").count() == 0
