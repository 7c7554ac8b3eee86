import random
import time

import numpy as np
import pyarrow as pa
import pytest

from pitspark.llm import substrings
from tests.llm.conftest import prose


def lane_of_messages(batches: int, names: int) -> pa.Table:
    """What one lane gets from so many batches, `names` in all. Every tenth name is shared with the next batch."""
    each = names // batches
    rows = []
    for batch in range(batches):
        own = np.arange(batch * each, (batch + 1) * each, dtype=np.uint64)
        own[::10] += np.uint64(each)
        rows += substrings._send(batch, 1, np.unique(own * np.uint64(0x9E3779B97F4A7C15)), np.zeros(each, np.uint8), np.full(each, batch, np.int64))
    return substrings._rows(rows, substrings._SENT, pa.Table)


@pytest.mark.parametrize("answer", [substrings._shared_grams, substrings._equal_windows])
def test_time_of_a_lane_follows_its_names_and_not_the_batches_times_names(answer):
    few, many = lane_of_messages(20, 400_000), lane_of_messages(20_000, 400_000)
    answer(few)
    began = time.process_time()
    answer(few)
    one = time.process_time() - began
    began = time.process_time()
    answer(many)
    assert time.process_time() - began < 8 * one + 0.5


def test_lanes_get_equal_shares_of_the_anchors():
    texts = [prose(i, 2000).encode() for i in range(20)]
    names = np.unique(np.concatenate([s.anchor for s in substrings.stretches(texts)]))
    sent = substrings._send(0, 64, names, np.zeros(len(names), np.uint8), np.zeros(len(names), np.int64))
    sizes = [len(row[2]) // 8 for row in sent]
    assert sum(sizes) == len(names) and max(sizes) < 2 * len(names) / 64


def test_messages_are_dealt_in_two_hops(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    common = [prose(100 + i, 40) for i in range(12)]
    rows = [(i if i % 50 else None, " ".join([prose(i, 20), rng.choice(common), prose(1000 + i, 15), rng.choice(common)[: rng.randint(30, 200)]])) for i in range(400)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
    texts = substrings.keyed_texts(spark.read.parquet(path))

    sent, real = [], substrings._exchange

    def counted(messages, answer, lanes, width, **more):
        sent.append((lanes, width, messages.groupBy("batch").count().agg({"count": "max"}).first()[0], messages.select("lane").distinct().count()))
        return real(messages, answer, lanes, width, **more)

    def cuts(**more):
        return sorted((r.rid, bytes(r.starts), bytes(r.ends)) for r in substrings.cut_spans(texts, batch_bytes=3000, lane_names=100, **more).collect())

    monkeypatch.setattr(substrings, "_exchange", counted)
    direct = cuts()
    assert [x[1] for x in sent] == [1, 1, 1] and sent[0][0] > 60
    sent.clear()
    assert cuts(fan=8) == direct and len(direct) > 300
    assert [x[1] for x in sent] == [-(-sent[0][0] // 8)] * 3
    assert max(x[3] for x in sent) <= 8 and sent[2][2] <= 8
