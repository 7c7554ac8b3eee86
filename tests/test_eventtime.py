"""State with timers: stream joins and recursions against their batch twins."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import exits
from pitspark.operators.asof import asof_join
from pitspark.streaming import stateful
from pitspark.streaming.eventtime import stream_asof
from tests.test_streaming import T0, drain, stream_of

BAR = "symbol string, ts timestamp, n long"
REL = "sym string, rel timestamp, rev int, v double"
MIN = dt.timedelta(minutes=1)


def _streams(spark, tmp_path, lefts, rights):
    a, b = tmp_path / "l", tmp_path / "r"
    a.mkdir(), b.mkdir()
    return stream_of(spark, a, lefts, BAR), stream_of(spark, b, rights, REL)


def _rows(seed=4, n=150, m=40):
    rng = np.random.default_rng(seed)
    bars = [("ABC"[i % 3], T0 + MIN * int(rng.integers(0, 300)), i) for i in range(n)]
    rel = [("AB"[i % 2], T0 + MIN * int(rng.integers(0, 300)), i, float(i)) for i in range(m)]
    rel += [(s, t, r + 1000, v + 0.5) for s, t, r, v in rel[:10]]  # revisions of the same minute
    return bars, rel


@pytest.mark.parametrize("strict,keyed,lanes", [(True, True, 1), (False, True, 3), (True, False, 4)])
def test_stream_asof_equals_batch(spark, tmp_path, strict, keyed, lanes):
    bars, rel = _rows()
    by = ["symbol"] if keyed else []
    early = [("A", T0 - MIN * 50, 1, -1.0), ("A", T0 - MIN * 20, 2, -2.0), ("B", T0 - MIN * 90, 3, -3.0)]
    odd = [(None, T0 + MIN * 200, -1), ("A", None, -2)]
    end_l, end_r = [("Z", T0 + MIN * 9000, -9)], [("Z", T0 + MIN * 9000, 0, 0.0)]
    left, right = _streams(spark, tmp_path, [bars[:70] + odd, bars[70:], end_l, end_l], [rel[25:], rel[:25], end_r, end_r])
    named = right.withColumnRenamed("sym", "symbol") if keyed else right
    known = spark.createDataFrame(early, REL)
    known = known.withColumnRenamed("sym", "symbol") if keyed else known
    out = stream_asof(
        left, named, left_time="ts", right_time="rel", columns=["v"], tie=["rev"], by=by, strict=strict,
        lateness="6 hours", known=known, lanes=lanes,
    )
    assert out.columns == ["symbol", "ts", "n", "v"]
    name = f"asof_{strict}_{keyed}"
    drain(out, tmp_path, name)
    got = [(r.n, r.v) for r in spark.table(name).filter("n <> -9").collect()]
    table = spark.createDataFrame(early + rel, REL).withColumnRenamed("sym", "symbol")
    want = asof_join(
        spark.createDataFrame(bars + odd, BAR), table, left_time="ts", right_time="rel", strict=strict, columns=["v"],
        by=by, tie=["rev"],
    )
    assert sorted(got) == sorted((r.n, r.v) for r in want.collect())


def test_stream_asof_tolerance_and_late_release(spark, tmp_path):
    bars = [("A", T0 + MIN * m, m) for m in (5, 10, 30, 90)]
    rel = [("A", T0, 1, 1.0), ("A", T0 + MIN * 25, 2, 2.0)]
    push = [("A", T0 + MIN * 600, 600)]
    late = [("A", T0 + MIN * 8, 3, 8.0)]  # far behind the watermark: dropped
    left, right = _streams(spark, tmp_path, [bars, push, push, push], [rel, [], late, late])
    right = right.withColumnRenamed("sym", "symbol")
    out = stream_asof(
        left, right, left_time="ts", right_time="rel", columns=["v"], by=["symbol"], strict=True, lateness="30 minutes",
        tolerance_seconds=1200,
    )
    drain(out, tmp_path, "asof_tol")
    got = {r.n: r.v for r in spark.table("asof_tol").collect() if r.n < 600}
    assert got == {5: 1.0, 10: 1.0, 30: 2.0, 90: None}


def test_rows_leave_once_the_watermark_has_passed(spark, tmp_path):
    batches = [[("A", T0 + MIN * (60 * b + i), 60 * b + i) for i in range(60)] for b in range(8)]
    left, right = _streams(spark, tmp_path, batches, [[("A", T0, 1, 1.0)]] * 8)
    right = right.withColumnRenamed("sym", "symbol")
    out = stream_asof(left, right, left_time="ts", right_time="rel", columns=["v"], by=["symbol"], strict=True, lateness="20 minutes")
    drain(out, tmp_path, "asof_state")
    # All but the rows of the last twenty minutes have come out.
    done = sorted(r.n for r in spark.table("asof_state").collect())
    assert done == list(range(8 * 60 - 1 - 20))


TRADE = "trade string, at timestamp, price double, atr double, entry_price double, entry_atr double, side double"
VALUES = ["price", "atr", "entry_price", "entry_atr", "side"]


def _trades(n=80):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(6):
        side, p = (1.0 if k % 2 else -1.0), 100 + np.cumsum(rng.normal(0, 1, n))
        for i in range(n):
            atr = None if rng.uniform() < 0.2 else float(rng.uniform(0.5, 2))
            rows.append((f"t{k}", T0 + MIN * i, float(p[i]), atr, 100.0, 1.5, side))
    return rows


def test_two_sided_stop_equals_batch(spark, tmp_path):
    rows = _trades()
    rng = np.random.default_rng(1)
    mixed = [rows[i] for i in rng.permutation(len(rows))]
    end = [("zz", T0 + dt.timedelta(days=3), 1.0, 1.0, 1.0, 1.0, 1.0)]
    s = stream_of(spark, tmp_path, [mixed[:200], mixed[200:], end, end], TRADE)
    out = stateful.run_recursion(
        s, stateful.TwoSidedStop(), key="trade", time="at", value=VALUES, out=["stop", "exit"], lateness="6 hours"
    )
    drain(out, tmp_path, "two_sided")
    got = {(r.trade, r.at): (r.stop, bool(r.exit)) for r in spark.table("two_sided").filter("trade <> 'zz'").collect()}
    batch = exits.atr_stop(spark.createDataFrame(rows, TRADE), trade=["trade"], time="at")
    want = {(r.trade, r.at): (r.stop, r.exit) for r in batch.collect()}
    assert got.keys() == want.keys() and any(e for _, e in want.values())
    for k, (stop, fires) in want.items():
        assert got[k][0] == pytest.approx(stop) and got[k][1] == fires


def test_initial_state_and_idle_keys(spark, tmp_path):
    rec = stateful.DrawdownBreaker()
    rng = np.random.default_rng(2)
    x = np.exp(np.cumsum(rng.normal(-0.004, 0.02, 120)))
    core, want = rec.start(), []
    for i, v in enumerate(x):
        if i == 60:
            half = list(core)
        core, y = rec.step(core, float(v))
        want.append(y)
    rows = [("k", T0 + MIN * i, float(x[i])) for i in range(60, 120)]
    after = [("k", T0 + dt.timedelta(days=9), 1.0)]
    end = [("z", T0 + dt.timedelta(days=5), 1.0)]
    last = [("z", T0 + dt.timedelta(days=20), 1.0)]
    s = stream_of(spark, tmp_path, [rows, end, end, after, last, last], "key string, at timestamp, x double")
    start = spark.createDataFrame([("k", [float(c) for c in half])], "key string, core array<double>")
    out = stateful.run_recursion(
        s, rec, key="key", time="at", value="x", out="y", lateness="1 hour", initial=start, idle_seconds=86_400
    )
    drain(out, tmp_path, "idle")
    got = [r.y for r in spark.table("idle").filter(F.col("key") == "k").orderBy("at").collect()]
    assert np.allclose(got[:60], want[60:])
    assert got[60] == 1.0  # after nine days the key starts anew
