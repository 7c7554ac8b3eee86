"""Operators against brute force on small random data, with chunks and blocks
small enough that every boundary case occurs."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitspark.functions.mathfn import clip, normal_cdf, softmax
from pitspark.operators import rolling as R
from pitspark.operators.asof import asof_join, event_within, nearest_events
from pitspark.operators.chunked import POS, Ewm, Running, SeriesKey, ewm_block, ewm_lookback, over_rows, over_time, row_positions, running, with_ewm
from pitspark.operators.intervals import count_between, flags_within, lookback_slots, trailing_count
from pitspark.operators.ranks import exact_quantiles, order_statistic, row_ranks

T0 = dt.datetime(2024, 1, 1)
C = F.col


def series(spark, n=400, hot=0.7, seed=1, ties=False):
    """Two series, one of them holding most of the rows, irregular in time."""
    rng = np.random.default_rng(seed)
    sym = np.where(rng.uniform(size=n) < hot, "hot", "cold")
    secs = rng.integers(0, 40_000, n) if ties else rng.choice(2_000_000, n, replace=False)
    if ties:
        secs = secs // 600 * 600
    x = rng.normal(10, 3, n)
    x = np.where(rng.uniform(size=n) < 0.1, np.nan, x)
    pdf = pd.DataFrame({"symbol": sym, "ts": [T0 + dt.timedelta(seconds=int(s)) for s in secs], "id": range(n), "x": x})
    rows = [(r.symbol, r.ts.to_pydatetime(), int(r.id), None if math.isnan(r.x) else float(r.x)) for r in pdf.itertuples()]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id long, x double")
    return df, pdf.sort_values(["symbol", "ts", "id"]).reset_index(drop=True)


KEY = SeriesKey(("symbol",), "ts", ("id",), chunk_seconds=3000)


def collect(df, col):
    return {r["id"]: r[col] for r in df.select("id", col).collect()}


def same(got, pdf, want, tol=1e-9):
    for i, w in zip(pdf["id"], want):
        g = got[i]
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert g is None, (i, g)
        else:
            assert g is not None and abs(g - w) <= tol * max(1, abs(w)), (i, g, w)


def test_row_positions(spark):
    df, pdf = series(spark)
    want = pdf.groupby("symbol").cumcount() + 1
    same(collect(row_positions(df, KEY, pos="p"), "p"), pdf, want.tolist())


@pytest.mark.parametrize("block", [7, 16, 64])
def test_rolling_blocks_equal_whole_series(spark, block):
    df, pdf = series(spark)

    def compute(d, w):
        return d.withColumns(
            {
                "m": R.mean(C("x"), 7, 3, w),
                "s": R.std(C("x"), 7, 3, w),
                "lag2": F.lag("x", 2).over(w),
                "lead1": F.lead("x").over(w),
                "d": R.diff(C("x"), 3, w),
            }
        )

    out = over_rows(df, KEY, compute, lookback=6, lookahead=1, block_rows=block).cache()
    g = pdf.groupby("symbol")["x"]
    same(collect(out, "m"), pdf, g.transform(lambda s: s.rolling(7, min_periods=3).mean()).tolist())
    same(collect(out, "s"), pdf, g.transform(lambda s: s.rolling(7, min_periods=3).std()).tolist(), 1e-8)
    same(collect(out, "lag2"), pdf, g.shift(2).tolist())
    same(collect(out, "lead1"), pdf, g.shift(-1).tolist())
    same(collect(out, "d"), pdf, g.transform(lambda s: s.diff(3)).tolist())
    assert out.count() == len(pdf)


def test_block_smaller_than_halo_is_refused(spark):
    df, _ = series(spark, 20)
    with pytest.raises(ValueError):
        over_rows(df, KEY, lambda d, w: d, lookback=10, block_rows=5)


def test_wide_moments_and_correlation(spark):
    df, pdf = series(spark)
    n = 120

    def compute(d, w):
        cnt, avg, var = R.moments(C("x"), n, w)
        y = C("x") * 0.5 + (C("id") % 7)
        return d.withColumns({"y": y}).withColumns(
            {"cnt": cnt, "avg": avg, "sd": F.sqrt(var), "cor": R.correlation(C("x"), C("y"), n, 30, w)}
        )

    out = over_rows(df, KEY, compute, lookback=n - 1, block_rows=130).cache()
    pdf = pdf.assign(y=pdf["x"] * 0.5 + pdf["id"] % 7)
    roll = pdf.groupby("symbol")["x"].rolling(n, min_periods=1)
    same(collect(out, "avg"), pdf, roll.mean().tolist(), 1e-8)
    sd = pdf.groupby("symbol")["x"].rolling(n, min_periods=2).std()
    same(collect(out, "sd"), pdf, sd.tolist(), 1e-6)
    cor = pd.concat([g["x"].rolling(n, min_periods=30).corr(g["y"]) for _, g in pdf.groupby("symbol")])
    same(collect(out, "cor"), pdf, cor.tolist(), 1e-6)


@pytest.mark.parametrize("alpha", [1 / 14, 2 / 6, 2 / 201])
def test_ewm_blocks_equal_recursion(spark, alpha):
    rng = np.random.default_rng(4)
    n = 9000 if alpha < 0.05 else 3000
    x = rng.normal(50, 5, n)
    rows = [("s", T0 + dt.timedelta(minutes=i), i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id long, x double")
    key = SeriesKey(("symbol",), "ts", ("id",), chunk_seconds=36_000)
    block = max(ewm_lookback(alpha), min(600, ewm_block(alpha)))
    out = over_rows(df, key, lambda d, w: with_ewm(d, w, {"y": Ewm(C("x"), alpha)}), lookback=ewm_lookback(alpha), block_rows=block)
    want = pd.Series(x).ewm(alpha=alpha, adjust=False).mean()
    got = [r.y for r in out.orderBy("id").collect()]
    assert np.allclose(got, want, rtol=1e-11)


def test_ewm_seed_position(spark):
    x = [None, None, 4.0, 6.0, 1.0]
    rows = [("s", T0 + dt.timedelta(minutes=i), i, v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id long, x double")
    out = over_rows(df, KEY, lambda d, w: with_ewm(d, w, {"y": Ewm(C("x"), 0.5, 3)}), lookback=60)
    assert [r.y for r in out.orderBy("id").collect()] == [None, None, 4.0, 5.0, 3.0]


def test_running_aggregates(spark):
    df, pdf = series(spark)
    specs = [
        Running("s", "sum", C("x")), Running("hi", "max", C("x")), Running("lo", "min", C("x")),
        Running("n", "count", C("x")), Running("last", "last", C("x")),
    ]
    out = running(df, KEY, specs).cache()
    g = pdf.groupby("symbol")["x"]
    same(collect(out, "s"), pdf, g.transform(lambda s: s.fillna(0).cumsum()).tolist())
    same(collect(out, "n"), pdf, g.transform(lambda s: s.notna().cumsum()).tolist())
    same(collect(out, "last"), pdf, g.ffill().tolist())
    same(collect(out, "hi"), pdf, g.transform(lambda s: s.cummax().ffill()).tolist())
    same(collect(out, "lo"), pdf, g.transform(lambda s: s.cummin().ffill()).tolist())


def test_over_time_is_open_on_the_left(spark):
    rows = [("s", T0 + dt.timedelta(seconds=s), i, float(i)) for i, s in enumerate([0, 100, 300, 301, 599, 600, 3300])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id long, x double")
    key = SeriesKey(("symbol",), "ts", ("id",), chunk_seconds=300)
    out = over_time(df, key, lambda d, w: d.withColumn("n", F.count("x").over(w.rangeBetween(-(300_000_000 - 1), 0))), seconds=300)
    assert [r.n for r in out.orderBy("id").collect()] == [1, 2, 2, 3, 3, 3, 1]


def brute_asof(left, right, strict, direction, by=True, tol=None):
    out = {}
    for k, t, i in left:
        best = None
        for rk, rt, rid in right:
            if t is None or rt is None or (by and (k is None or rk != k)):
                continue
            if direction == "backward":
                ok = rt < t if strict else rt <= t
                better = best is None or (rt, rid) > best
            else:
                ok = rt > t if strict else rt >= t
                better = best is None or (rt, rid) < best
            if ok and better:
                best = (rt, rid)
        if best and tol is not None and abs((t - best[0]).total_seconds()) > tol:
            best = None
        out[i] = best[1] if best else None
    return out


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("by", [True, False])
def test_asof_equals_brute_force(spark, strict, direction, by):
    rng = np.random.default_rng(8)
    keys = ["hot"] * 8 + ["cold", None]

    def rows(n):
        out = []
        for i in range(n):
            t = None if rng.uniform() < 0.03 else T0 + dt.timedelta(seconds=int(rng.integers(0, 200)) * 60)
            out.append((keys[rng.integers(0, 10)], t, i))
        return out

    left, right = rows(300), rows(120)
    ld = spark.createDataFrame(left, "k string, t timestamp_ntz, id long")
    rd = spark.createDataFrame(right, "k string, rt timestamp_ntz, rid long")
    for tol in (None, 300):
        out = asof_join(
            ld, rd, left_time="t", right_time="rt", strict=strict, direction=direction, by=["k"] if by else [],
            tie=["rid"], columns=["rid"], tolerance_seconds=tol, bucket_seconds=1800,
        )
        assert {r.id: r.rid for r in out.collect()} == brute_asof(left, right, strict, direction, by, tol)


def test_asof_with_empty_right(spark):
    ld = spark.createDataFrame([("a", T0, 1)], "k string, t timestamp_ntz, id long")
    rd = spark.createDataFrame([], "k string, rt timestamp_ntz, v double")
    out = asof_join(ld, rd, left_time="t", right_time="rt", strict=True, by=["k"], columns=["v"])
    assert [tuple(r) for r in out.collect()] == [("a", T0, 1, None)]


def test_asof_plan_has_no_nested_loop_and_reads_sides_once(spark, tmp_path):
    df, _ = series(spark)
    path = str(tmp_path / "p")
    df.write.parquet(path)
    src = spark.read.parquet(path)
    out = asof_join(src, src.select("symbol", C("ts").alias("rt"), "x"), left_time="ts", right_time="rt", strict=True, by=["symbol"], columns=["x"], prefix="r_")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert plan.count("FileScan") == 2 and "ReusedExchange" in plan


def test_window_plan_reads_source_once(spark, tmp_path):
    df, _ = series(spark)
    path = str(tmp_path / "p")
    df.write.parquet(path)
    out = over_rows(spark.read.parquet(path), KEY, lambda d, w: d.withColumn("m", R.mean(C("x"), 5, 1, w)), lookback=4)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "SinglePartition" not in plan


def test_nearest_events_and_flags(spark):
    grid = spark.createDataFrame([(T0 + dt.timedelta(hours=h),) for h in range(48)], "at timestamp_ntz")
    ev = [(T0 + dt.timedelta(hours=10, minutes=30), "x"), (T0 + dt.timedelta(hours=40), "y")]
    events = spark.createDataFrame(ev, "ts timestamp_ntz, kind string")
    near = nearest_events(grid, events, left_time="at", event_time="ts", bucket_seconds=7200)
    flag = event_within(C("prev_event"), C("next_event"), C("at"), 3600)
    got = {r.at: r.f for r in near.select("at", flag.alias("f")).collect()}
    want = {t: any(abs((t - e).total_seconds()) <= 3600 for e, _ in ev) for t in got}
    assert got == want
    flags = flags_within(grid, events, at="at", event_time="ts", seconds=3600, flags={"x": C("kind") == "x", "z": C("kind") == "z"}, bucket_seconds=7200)
    rows = {r["at"]: (r["x"], r["z"]) for r in flags.collect()}
    assert rows == {t: (abs((t - ev[0][0]).total_seconds()) <= 3600, False) for t in rows}


def test_counts_slots_and_trailing_counts(spark):
    rng = np.random.default_rng(2)
    grid = [(s, T0 + dt.timedelta(hours=int(h))) for s in "ab" for h in sorted(rng.choice(60, 30, replace=False))]
    arts = [(i, T0 + dt.timedelta(minutes=int(m)), "hot" if i % 3 else "rare") for i, m in enumerate(rng.integers(0, 3600, 150))]
    g = spark.createDataFrame(grid, "symbol string, at timestamp_ntz")
    a = spark.createDataFrame(arts, "aid long, vis timestamp_ntz, src string")
    key = SeriesKey(("symbol",), "at", (), 36_000)
    got = {(r.symbol, r["at"]): r.n for r in count_between(g, a, key=key, event_time="vis", event_tie=("aid",), first_seconds=3600, out="n", chunk_seconds=7200).collect()}
    for s in "ab":
        prev = None
        for t in sorted(t for k, t in grid if k == s):
            lo = prev or t - dt.timedelta(hours=1)
            assert got[(s, t)] == sum(lo < v <= t for _, v, _ in arts)
            prev = t
    slots = lookback_slots(g, a, by=("symbol",), at="at", event_time="vis", event_id="aid", seconds=4 * 3600, slots=3, chunk_seconds=7200)
    for r in slots.collect():
        seen = sorted((v, i) for i, v, _ in arts if r["at"] - dt.timedelta(hours=4) <= v < r["at"])
        assert r.slots == [i for _, i in seen[:3]]
    cnt = trailing_count(a, by=["src"], time="vis", tie=["aid"], seconds=7200, out="n", bucket_seconds=3600)
    for r in cnt.collect():
        assert r.n == sum(s == r.src and r.vis - dt.timedelta(hours=2) < v <= r.vis for _, v, s in arts)


@pytest.mark.parametrize("kind", ["normal", "ties", "constant"])
def test_ranks_and_quantiles(spark, kind):
    rng = np.random.default_rng(6)
    n = 3000
    v = {"normal": rng.normal(size=n), "ties": np.round(rng.normal(size=n), 1), "constant": np.full(n, 3.0)}[kind]
    v = np.where(rng.uniform(size=n) < 1 / 3, v[0], v)  # one value holds a third of the rows
    g = np.where(rng.uniform(size=n) < 0.9, "a", "b")
    pdf = pd.DataFrame({"g": g, "v": v, "id": range(n)})
    df = spark.createDataFrame([(str(a), float(b), int(i)) for a, b, i in zip(g, v, range(n))], "g string, v double, id long")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"q1": 1 / 3, "q9": 0.9}, bins=16).collect()}
    for k, s in pdf.groupby("g")["v"]:
        assert math.isclose(got[k].q1, s.quantile(1 / 3), rel_tol=1e-12, abs_tol=1e-12)
        assert math.isclose(got[k].q9, s.quantile(0.9), rel_tol=1e-12, abs_tol=1e-12)
        assert got[k].n_values == len(s)
    ks = {r.g: r.k for r in order_statistic(df, ["g"], "v", F.lit(17), "k", bins=16).collect()}
    assert ks == {k: sorted(s)[16] for k, s in pdf.groupby("g")["v"]}
    ranks = {r.id: r.rk for r in row_ranks(df, ["g"], "v", "id", out="rk", tie_width=100, bins=16).collect()}
    pdf = pdf.sort_values(["g", "v", "id"])
    assert [ranks[i] for i in pdf["id"]] == (pdf.groupby("g").cumcount() + 1).tolist()
    total = exact_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert math.isclose(total[0].m, np.median(v), abs_tol=1e-12)


def test_scalar_functions(spark):
    df = spark.createDataFrame([(-1.5,), (0.3,), (9.0,), (None,)], "z double")
    got = df.select(clip(C("z"), 0, 5).alias("c"), normal_cdf(C("z")).alias("p")).collect()
    assert [r.c for r in got] == [0.0, 0.3, 5.0, None]
    assert all(abs(r.p - NormalDist().cdf(z)) < 1e-14 for r, z in zip(got, (-1.5, 0.3, 9.0)))
    p = spark.range(1).select(softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), 2.0).alias("p")).first().p
    e = np.exp(np.array([1.0, 2.0, 4.0]) / 2)
    assert np.allclose(p, e / e.sum())


def prefix_stable(df, op, time, cut):
    """Values up to a cut do not change when the future is removed."""
    past = F.col(time) <= F.lit(cut)
    a, b = op(df).filter(past), op(df.filter(past))
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_no_window_feature_sees_the_future(spark):
    df, _ = series(spark)
    df = df.withColumn("x", F.abs("x") + 1)

    def op(d):
        def compute(q, w):
            hi, lo = R.channel(C("x"), C("x"), 5, w)
            q = with_ewm(q, w, {"b": Ewm(C("x"), 0.2)}).withColumn("b", F.round("b", 9))
            return q.withColumns(
                {
                    "a": R.zscore(C("x"), 10, 3, w), "c": hi, "d": lo,
                    "e": R.percent_b(C("x"), 8, 2.0, w), "f": R.log_return(C("x"), 2, w), "g": F.col(POS),
                }
            )

        return over_rows(d, KEY, compute, lookback=200, block_rows=256).select("id", "ts", "a", "b", "c", "d", "e", "f", "g")

    assert prefix_stable(df, op, "ts", T0 + dt.timedelta(seconds=900_000))


def test_ewm_over_gaps(spark):
    x = [None, 10.0, 10.0, None, 10.0, 4.0, None, None, None, 8.0, None]
    rows = [("s", T0 + dt.timedelta(minutes=i), i, v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id long, x double")
    for alpha in (0.5, 1 / 14):
        out = over_rows(df, KEY, lambda d, w: with_ewm(d, w, {"y": Ewm(C("x"), alpha)}), lookback=11, block_rows=11)  # noqa: B023
        want = pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False).mean()
        got = collect(out, "y")
        assert [got[i] is None for i in range(len(x))] == want.isna().tolist()
        assert all(w != w or abs(got[i] - w) < 1e-9 for i, w in enumerate(want))


@pytest.mark.parametrize("fan", [2, 1024])
def test_ewm_carries_on_over_gaps_longer_than_blocks(spark, fan):
    """Nulls over many blocks, at the start, and a series without any value; blocks far shorter than the memory."""
    rng = np.random.default_rng(6)
    x = rng.normal(50, 5, 1500)
    x[:70] = x[300:900] = x[1200:1201] = x[1490:] = np.nan
    series_x = {"a": x, None: np.full(90, np.nan), "b": rng.normal(0, 1, 333)}
    rows = [(s, T0 + dt.timedelta(minutes=i), i, None if v != v else float(v)) for s, xs in series_x.items() for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id long, x double")
    specs = {"y": Ewm(C("x"), 1 / 14), "z": Ewm(C("x"), 2 / 201)}

    def compute(d, w):
        d = with_ewm(d, w, specs, fan=fan)
        d = d.withColumn("before", F.lag("y").over(w))
        return with_ewm(d, w, {"yy": Ewm(C("y"), 0.3)}, fan=fan)

    out = over_rows(df, SeriesKey(("symbol",), "ts", ("id",), chunk_seconds=7200), compute, lookback=1, block_rows=32)
    got = out.toPandas().sort_values("id")
    for s, xs in series_x.items():
        g = got[got["symbol"].isna() if s is None else got["symbol"] == s]
        ewm = lambda v, alpha: v.ewm(alpha=alpha, adjust=False).mean()
        y = ewm(pd.Series(xs), 1 / 14)
        for c, want in {"y": y, "z": ewm(pd.Series(xs), 2 / 201), "before": y.shift(), "yy": ewm(y, 0.3)}.items():
            assert np.allclose(g[c].to_numpy(dtype=float), want, rtol=1e-10, equal_nan=True), (s, c)


def test_rows_without_key_or_time_stay(spark):
    rows = [(s, None if i % 9 == 0 else T0 + dt.timedelta(minutes=i), i, float(i)) for i, s in enumerate([None, "a", "b"] * 30)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id long, x double")
    pdf = pd.DataFrame(rows, columns=["symbol", "ts", "id", "x"])
    pdf["symbol"] = pdf["symbol"].fillna("?")
    pdf["o"] = pdf["ts"].isna().map({True: 0, False: 1})
    pdf = pdf.sort_values(["symbol", "o", "ts", "id"])
    pos = collect(row_positions(df, KEY, pos="p"), "p")
    assert [pos[i] for i in pdf["id"]] == (pdf.groupby("symbol").cumcount() + 1).tolist()
    total = collect(running(df, KEY, [Running("t", "sum", C("x"))]), "t")
    same(total, pdf, pdf.groupby("symbol")["x"].cumsum().tolist())
    assert over_rows(df, KEY, lambda d, w: d, lookback=1).count() == len(rows)
    assert over_time(df, KEY, lambda d, w: d.withColumn("n", F.count("x").over(w.rangeBetween(-60_000_000, 0))), seconds=60).count() == len(rows)


def test_identical_grid_rows_stay(spark):
    grid = spark.createDataFrame([(T0,), (T0,), (T0 + dt.timedelta(hours=5),)], "bar timestamp_ntz")
    events = spark.createDataFrame([(T0 - dt.timedelta(minutes=1), "x", 1)], "at timestamp_ntz, kind string, id long")
    flags = flags_within(grid, events, at="bar", event_time="at", seconds=600, flags={"x": C("kind") == "x"}).collect()
    assert sorted(r.x for r in flags) == [False, True, True]
    slots = lookback_slots(grid, events, by=[], at="bar", event_time="at", event_id="id", seconds=600, slots=3).collect()
    assert sorted(r.slots for r in slots) == [[], [1], [1]]


def test_correlation_of_constant_and_drifting_series(spark):
    rows = [("s", T0 + dt.timedelta(minutes=i), i, 5.0, 1e9 + i + (i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id long, c double, y double")

    def compute(d, w):
        return d.withColumns({"k": R.correlation(C("c"), C("y"), 120, 30, w), "r": R.correlation(C("y"), C("id").cast("double"), 120, 30, w), "v": R.std(C("y"), 120, 30, w)})

    out = over_rows(df, KEY, compute, lookback=119).collect()
    y = pd.Series([r[4] - 1e9 for r in rows])
    assert all(r.k is None for r in out)
    want = dict(enumerate(y.rolling(120, min_periods=30).std()))
    assert all(r.v is None if want[r.id] != want[r.id] else abs(r.v - want[r.id]) < 1e-6 for r in out)
    corr = dict(enumerate(y.rolling(120, min_periods=30).corr(pd.Series(range(200), dtype=float))))
    assert all(r.r is None if corr[r.id] != corr[r.id] else abs(r.r - corr[r.id]) < 1e-6 for r in out)
