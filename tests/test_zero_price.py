"""Bars that touch zero: logarithms as the SQL has them."""

import math
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pitspark.operators import rolling as R
from pitspark.operators.chunked import SeriesKey, over_rows
from tests.oracle import TABLES, compare, duck

SF = Path("/root/testdata/sf0.001")
C = F.col


@pytest.fixture(scope="module")
def zero_prices(tmp_path_factory):
    """The smallest tables, with some prices at zero."""
    if not SF.exists():
        pytest.skip("test tables are not here")
    out = tmp_path_factory.mktemp("zero")
    for t in TABLES:
        (out / f"{t}.parquet").symlink_to(SF / f"{t}.parquet")
    events = pq.read_table(SF / "events.parquet")
    hit = pa.array([i % 29 == 0 for i in events["event_id"].to_pylist()])
    value = pc.if_else(hit, 0.0, events["value"])
    (out / "events.parquet").unlink()
    pq.write_table(events.set_column(events.schema.get_field_index("value"), "value", value), out / "events.parquet")
    return str(out)


def test_garman_klass_of_zero_lows(spark, zero_prices):
    ok, message, _ = compare(spark, duck(zero_prices), "garman_klass", zero_prices)
    assert ok, message


def test_garman_klass_leaves_the_infinite_bar_behind(spark):
    rows = [("a", i, 2.0, 3.0, 0.0 if i == 1 else 1.0, 2.0) for i in range(5)] + [("b", i, 0.0 if i == 1 else 2.0, 3.0, 0.0 if i == 1 else 1.0, 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "s string, i long, o double, h double, l double, c double").withColumn("t", F.timestamp_seconds("i").cast("timestamp_ntz"))
    out = over_rows(df, SeriesKey(("s",), "t"), lambda d, w: d.withColumn("v", R.garman_klass(C("o"), C("h"), C("l"), C("c"), 2, 1, w)), lookback=2)
    got = {(r.s, r.i): r.v for r in out.collect()}
    assert [got["a", i] for i in (1, 2)] == [math.inf, math.inf]
    assert all(math.isnan(got["b", i]) for i in (1, 2))
    assert all(abs(got[s, i] - math.sqrt(0.5) * math.log(3)) < 1e-12 for s in "ab" for i in (0, 3, 4))
