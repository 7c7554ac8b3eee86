"""Row numbers must not depend on how a scan is split: splits change when executors come or go between two scans."""

from collections import Counter
from itertools import cycle

import pytest
from pyspark.sql import functions as F

from pitspark.llm import common, decontam, exact, nearmatch, substrings
from tests.llm.conftest import prose

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def shifting(spark, tmp_path, monkeypatch):
    """A table of five files with copies, near copies and a benchmark hit; every stored table changes the splits."""
    rows = []
    for i in range(60):
        text = prose(100 + i, 80)
        rows += [(3 * i, text), (3 * i + 1, text), (3 * i + 2, text + " tail")] if i % 2 else [(3 * i, text)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    bench = spark.createDataFrame([(1, prose(101, 80)), (2, prose(104, 40))], "item_id long, text string")
    old, sizes, plain = spark.conf.get(SPLIT), cycle(["700", "128m", "2000", "300"]), common.stored

    def stored(df):
        out = plain(df)
        spark.conf.set(SPLIT, next(sizes))
        return out

    docs = spark.read.parquet(path)
    run = {
        "exact": lambda: exact.keep_first(docs),
        "near": lambda: nearmatch.keep_one(docs),
        "clean": lambda: decontam.keep_clean(docs, bench),
        "strip": lambda: substrings.strip(docs).drop("rid"),
    }

    def change():
        for module in (common, exact, nearmatch, decontam, substrings):
            monkeypatch.setattr(module, "stored", stored)

    yield run, change
    spark.conf.set(SPLIT, old)


@pytest.mark.parametrize("name", ["exact", "near", "clean", "strip"])
def test_results_with_changing_splits(shifting, name):
    run, change = shifting
    want = Counter(map(tuple, run[name]().collect()))
    change()
    assert Counter(map(tuple, run[name]().collect())) == want


def test_numbers_of_scans_and_of_other_frames(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.range(1000).withColumn("path", F.lit("x")).repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    for df in (docs, docs.filter("id > 10").select("id", "path"), docs.union(docs), docs.crossJoin(spark.range(2).toDF("k")), spark.range(9).withColumn("path", F.lit(1))):
        numbered = common.with_row_id(df, "n")
        assert numbered.columns == [*df.columns, "n"]
        got = numbered.collect()
        assert len({r.n for r in got}) == len(got) == df.count()
