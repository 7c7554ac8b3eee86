"""Journaled cursor: restarts, failures and pages of equal times."""

import datetime as dt

import pytest

from pitspark.sources import cursor
from pitspark.streaming.bars import dedupe_articles

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "article_id long, created_at timestamp, title string"


def add(spark, path, ids, minutes):
    rows = [(i, T0 + dt.timedelta(minutes=m), f"t{i}") for i, m in zip(ids, minutes)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def feed(spark, path, **kw):
    args = {"path": path, "time": "created_at", "id": "article_id", "columns": ["title"]}
    return cursor.stream_feed(spark, cursor.TableFeed, args, window_seconds=600, page=3, **kw)


def run(df, out, cp):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    add(spark, src, range(40), [i // 8 * 7 for i in range(40)])  # eight rows an instant, pages of three
    run(feed(spark, src), out, cp)
    assert sorted(r.article_id for r in spark.read.parquet(out).collect()) == list(range(40))
    run(feed(spark, src), out, cp)  # nothing new
    add(spark, src, range(40, 55), range(100, 115))
    run(feed(spark, src), out, cp)
    add(spark, src, [55], [2000])
    run(feed(spark, src), out, cp)
    got = [r.article_id for r in spark.read.parquet(out).collect()]
    assert sorted(got) == list(range(56))


def test_a_failed_batch_is_read_again_with_the_same_range(spark, tmp_path):
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    add(spark, src, range(10), range(10))
    seen, fail = {}, [True]

    def sink(df, batch):
        seen.setdefault(batch, []).append(sorted(r.article_id for r in df.collect()))
        if fail[0]:
            raise RuntimeError("down")

    def go():
        q = feed(spark, src).writeStream.foreachBatch(sink).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="down"):
        go()
    add(spark, src, [10, 11], [50, 51])  # comes in before the restart
    fail[0] = False
    go()  # Spark gives such a source one batch a run: the one that failed
    go()
    assert seen[0] == [list(range(10)), list(range(10))]
    assert sorted(i for runs in seen.values() for i in runs[-1]) == list(range(12))


def test_settling_rows_wait_and_repeats_are_dropped(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    add(spark, src, [1, 2, 3], [0, 10, 60])
    run(dedupe_articles(feed(spark, src, settle_seconds=1800)), out, cp)
    assert sorted(r.article_id for r in spark.read.parquet(out).collect()) == [1, 2]
    add(spark, src, [4, 2, 5], [40, 45, 200])  # 4 is late but inside the settling time, 2 is a repeat
    run(dedupe_articles(feed(spark, src, settle_seconds=1800)), out, cp)
    assert sorted(r.article_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_start_and_batch_read(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    add(spark, src, range(20), range(20))
    run(feed(spark, src, start="2024-03-01T00:15:00"), out, cp)
    assert sorted(r.article_id for r in spark.read.parquet(out).collect()) == [15, 16, 17, 18, 19]
    args = {"path": src, "time": "created_at", "id": "article_id"}
    whole = cursor.read_feed(spark, cursor.TableFeed, args, window_seconds=300, page=2)
    assert whole.columns == ["article_id", "created_at", "title"] and whole.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, spark.read.parquet(src).collect()))
