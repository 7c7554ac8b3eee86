"""Hand-built inputs with known answers, contracts, sinks and rules."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.functions import sessions as S
from pitspark.functions import sizing as Z
from pitspark.functions import text as X
from pitspark.functions import visibility as V
from pitspark.operators import backtest as B
from pitspark.operators import calibration as K
from pitspark.operators import exits, folds, labels
from pitspark.operators.asof import asof_join, event_within, nearest_events
from pitspark.operators.calendars import easter_sunday, event_schedule, is_session
from pitspark.operators.chunked import SeriesKey, over_rows
from pitspark.operators.intervals import count_between
from pitspark.operators.sequential import (
    adaptive_alpha, breaker_step, drawdown_breaker, expert_discount, initial_alphas, step_alphas, step_weights,
)
from pitspark.operators.versions import latest_by
from pitspark.sources import builds, contracts, ingest, snapshot

C = F.col
D = dt.datetime


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def ts(s):
    return F.lit(s).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def three_bars(spark):
    rows = [("GLD", D(2024, 1, 15, 14, 0), 100.0), ("GLD", D(2024, 1, 15, 14, 30), 100.5), ("GLD", D(2024, 1, 15, 15, 0), 100.3)]
    df = spark.createDataFrame(rows, "symbol string, bar_open timestamp_ntz, close double")
    return df.withColumn("bar_close", V.bar_end(C("bar_open"))).withColumn("t_visible", C("bar_close"))


KEY = SeriesKey(("symbol",), "bar_close")


def test_strict_asof_excludes_the_instant(spark, three_bars):
    sig = spark.createDataFrame([(D(2024, 1, 15, 14, 30), 42)], "vis timestamp_ntz, v int")
    out = asof_join(three_bars, sig, left_time="bar_close", right_time="vis", strict=True, columns=["v"])
    assert [r.v for r in out.orderBy("bar_open").collect()] == [None, 42, 42]


def test_lag_one_close(three_bars):
    out = over_rows(three_bars, KEY, lambda d, w: d.withColumn("lag1", F.lag("close").over(w)), lookback=1)
    assert [r.lag1 for r in out.orderBy("bar_open").collect()] == [None, 100.0, 100.5]


def test_two_articles_are_counted_once_each(spark, three_bars):
    a = spark.createDataFrame([(1, D(2024, 1, 15, 14, 25)), (2, D(2024, 1, 15, 14, 40))], "aid long, created timestamp_ntz")
    a = a.withColumn("vis", V.after_latency(C("created")))
    out = count_between(three_bars, a, key=KEY, event_time="vis", event_tie=("aid",), first_seconds=1800, out="n")
    assert [r.n for r in out.orderBy("bar_open").collect()] == [1, 1, 0]


def test_event_flags_all_three_bars(spark, three_bars):
    ev = spark.createDataFrame([(D(2024, 1, 15, 14, 30),)], "ts timestamp_ntz")
    near = nearest_events(three_bars, ev, left_time="bar_close", event_time="ts")
    flag = event_within(C("prev_event"), C("next_event"), C("bar_close"), 3600)
    assert [r.f for r in near.select(flag.alias("f")).collect()] == [True] * 3


def test_visibility_rules(spark):
    d = lambda s: F.lit(s).cast("date")
    r = one(
        spark,
        V.weekly_report(d("2024-01-09")).alias("plain"),
        V.weekly_report(d("2024-03-26")).alias("holiday"),
        V.release_time_of_day(d("2024-01-18"), F.lit("WALCL")).alias("walcl"),
        V.release_time_of_day(d("2024-07-18"), F.lit("ICSA")).alias("icsa"),
        V.release_time_of_day(d("2024-01-18"), F.lit("nope")).alias("unknown"),
        V.monthly_index(d("2024-01-01")).alias("monthly"),
        V.first_business_day(d("2024-01-01")).alias("bday"),
        V.settlement(d("2024-01-02"), F.lit("CL=F")).alias("settle"),
        V.next_open(ts("2024-03-09 12:00:00")).alias("open"),
    )
    assert r.plain == D(2024, 1, 12, 21, 0) and r.holiday == D(2024, 4, 1, 20, 0)
    assert r.walcl == D(2024, 1, 18, 21, 30) and r.icsa == D(2024, 7, 18, 12, 30) and r.unknown is None
    assert r.monthly == D(2024, 2, 7, 12) and r.bday == D(2024, 3, 1, 12)
    assert r.settle == D(2024, 1, 2, 19, 30) and r.open == D(2024, 3, 10, 13, 30)


def test_trading_days(spark):
    days = {
        "2024-03-29": False, "2024-01-15": False, "2024-07-04": False, "2024-06-19": False, "2021-06-18": True, "2022-06-20": False,
        "2021-12-31": True, "2022-12-26": False, "2024-12-25": False, "2024-11-28": False, "2024-11-29": True, "2024-05-27": False, "2024-01-06": False,
        "2025-01-09": False, "2024-01-02": True,
    }
    df = spark.createDataFrame([(k,) for k in days], "d string").select("d", is_session(C("d").cast("date")).alias("s"))
    assert {r.d: r.s for r in df.collect()} == days
    easter = {2019: dt.date(2019, 4, 21), 2024: dt.date(2024, 3, 31), 2025: dt.date(2025, 4, 20), 2038: dt.date(2038, 4, 25)}
    df = spark.createDataFrame([(y,) for y in easter], "y int").select("y", easter_sunday(C("y")).alias("e"))
    assert {r.y: r.e for r in df.collect()} == easter


def test_schedule(spark):
    span = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 12, 31),)], "t timestamp_ntz")
    rows = event_schedule(span, "t").collect()
    got = {}
    for r in rows:
        got.setdefault(r.event_type, []).append(r.event_ts)
    assert {k: len(v) for k, v in got.items()} == {"FOMC": 8, "FOMC_minutes": 8, "NFP": 12, "CPI": 12, "JOLTS": 12, "PCE": 12, "GDP": 4}
    assert min(got["NFP"]) == D(2024, 1, 5, 13, 30) and max(got["GDP"]) == D(2024, 10, 31, 12, 30)
    assert D(2024, 6, 12, 18, 0) in got["FOMC"] and all(r.t_visible == r.event_ts - dt.timedelta(days=365) for r in rows)


def test_session_index(spark):
    rows = [(D(2024, 1, 15, 14, 30), 0, 0), (D(2024, 1, 15, 20, 30), 12, 3), (D(2024, 1, 15, 14, 0), -1, -1), (D(2024, 1, 15, 21, 0), -1, -1), (D(2024, 7, 15, 17, 30), 8, 1)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, i int, p int")
    for r in df.select("i", "p", S.session_bar_index(C("t")).alias("gi"), S.session_phase(C("t")).alias("gp")).collect():
        assert r.gi == r.i and r.gp == r.p


def test_irregular_gap(spark):
    from pitspark.operators.quality import irregular_gap

    rows = [("c", D(2025, 9, 30)), ("c", D(2025, 10, 7)), ("c", D(2026, 1, 15)), ("c", D(2026, 1, 22))]
    df = spark.createDataFrame(rows, "c string, d timestamp_ntz")
    out = over_rows(df, SeriesKey(("c",), "d"), lambda q, w: q.withColumn("g", irregular_gap(C("d"), w)), lookback=1)
    assert [r.g for r in out.orderBy("d").collect()] == [False, False, True, False]


def test_labels(spark):
    rows = [(0.002, 0.001, 5.0, 1), (-0.002, 0.001, 5.0, -1), (0.0004, 0.0001, 5.0, 0), (0.0005, 0.001, 1.0, 0), (None, 0.001, 1.0, 0), (0.01, 0.0, 1.0, 0), (0.01, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "r double, b double, s double, want int")
    for r in df.select("want", labels.triple_barrier_label(C("r"), C("b"), C("b"), C("s")).alias("g")).collect():
        assert r.g == r.want
    got = df.select(labels.fixed_label(C("r")).alias("g")).collect()
    assert [r.g for r in got] == [2, 0, 1, 1, None, 2, 2]


def test_folds_are_disjoint_and_half_open(spark):
    rows = [("s", D(2010, 1, 1) + dt.timedelta(days=i)) for i in range(2200)]
    df = spark.createDataFrame(rows, "symbol string, t timestamp_ntz")
    table = folds.fold_table(df, ["symbol"], "t")
    a = folds.assign_folds(df, table, ["symbol"], "t")
    assert a.groupBy("symbol", "t", "fold").count().filter("count > 1").count() == 0
    bad = folds.malformed(table, folds.fold_sizes(a, ["symbol"]), ["symbol"]).filter(~C("ok")).count()
    assert bad == 0
    first = table.filter("fold = 0").first()
    assert first.train_end == D(2013, 1, 1) and first.val_start == D(2013, 1, 8) and first.test_end == D(2014, 1, 15)


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(3)
    r, pos = rng.normal(0, 0.01, 300), rng.choice([-1.0, 0.0, 1.0], 300)
    rows = [("s", D(2024, 1, 1) + dt.timedelta(hours=i), float(a), float(p)) for i, (a, p) in enumerate(zip(r, pos))]
    df = spark.createDataFrame(rows, "symbol string, bar_close timestamp_ntz, next_return double, position double")
    key = SeriesKey(("symbol",), "bar_close", (), 40 * 3600)
    bt = B.backtest(df, key)
    m = B.metrics(bt, ["symbol"]).first()
    pnl = pos * r - 2.0 * np.abs(np.diff(pos, prepend=0.0)) / 1e4
    eq = np.exp(np.cumsum(pnl))
    peak = np.maximum.accumulate(eq)
    assert np.isclose(m.sharpe, pnl.mean() / pnl.std(ddof=1) * np.sqrt(3276))
    assert np.isclose(m.sortino, pnl.mean() / np.sqrt((np.minimum(pnl, 0) ** 2).mean()) * np.sqrt(3276))
    assert np.isclose(m.max_drawdown, ((peak - eq) / peak).max()) and m.n_bars == 300
    assert np.isclose(m.profit_factor, pnl[pnl > 0].sum() / -pnl[pnl < 0].sum())
    s = B.monotone(B.cost_stress(df, key), ["symbol"]).first()
    assert s.monotone
    boot = B.bootstrap_sharpe(bt, key, replicates=300).first()
    assert boot.ci_low < m.sharpe < boot.ci_high


def test_bootstrap_resamples_exactly_n_rows(spark):
    # With a constant return every replicate has the same mean, whatever the blocks.
    rows = [("s", D(2024, 1, 1) + dt.timedelta(hours=i), 1.0 if i % 2 else 2.0) for i in range(64)]
    df = spark.createDataFrame(rows, "symbol string, bar_close timestamp_ntz, pnl double")
    out = B.bootstrap_sharpe(df, SeriesKey(("symbol",), "bar_close"), replicates=50, block=4, bars_per_year=1).first()
    # mean in [1, 2] and deviation <= 0.5 bound every replicate's ratio from below by 2.
    assert out.ci_low >= 2.0


def test_sequential_scans_equal_plain_loops(spark):
    rng = np.random.default_rng(9)
    eq = np.exp(np.cumsum(rng.normal(-0.002, 0.02, 900)))
    miss = (rng.uniform(size=900) < 0.15).astype(float)
    rows = [("k", D(2024, 1, 1) + dt.timedelta(hours=i), float(e), float(m)) for i, (e, m) in enumerate(zip(eq, miss))]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, equity double, missed double")
    key = SeriesKey(("k",), "t", (), 30 * 3600)
    got = [r.size_multiplier for r in drawdown_breaker(df, key, equity="equity", block_rows=37).orderBy("t").collect()]
    peak, halted, count, want = 1.0, False, 0, []
    for e in eq:
        peak = max(peak, e)
        dd = (e - peak) / peak
        level = 3 if dd <= -0.15 + 1e-9 else 2 if dd <= -0.1 + 1e-9 else 1 if dd <= -0.05 + 1e-9 else 0
        state, halted, count = breaker_step(level, halted, count)
        want.append((1.0, 0.5, 0.25, 0.0)[state])
    assert got == want and len(set(want)) == 4
    a, w, used = initial_alphas(), np.full(5, 0.2), []
    for m in miss:
        used.append(np.clip((w * a).sum(), 0.001, 0.5))
        a = step_alphas(a, m)
        w = step_weights(w, expert_discount(a, m))
    out = adaptive_alpha(df, key, missed="missed", block_rows=41).orderBy("t").collect()
    assert np.allclose([r.alpha for r in out], used, atol=1e-12)


def test_sizing(spark):
    r = one(
        spark,
        Z.vol_target(F.lit(1e-4)).alias("vt"), Z.vol_target(F.lit(0.0)).alias("cap"), Z.vol_target(F.lit(None).cast("double")).alias("none"),
        Z.kelly(F.lit(0.01), F.lit(0.1), 0.002).alias("k"), Z.kelly(F.lit(0.01), F.lit(0.0)).alias("novar"), Z.kelly(F.lit(0.001), F.lit(0.1), 0.01).alias("costly"),
        Z.kelly(F.lit(0.9), F.lit(0.01)).alias("capped"), Z.confidence_floor(F.lit(0.5), F.lit(0.39)).alias("low"), Z.confidence_floor(F.lit(0.5), F.lit(0.4)).alias("ok"),
    )
    assert np.isclose(r.vt, 0.15 / np.sqrt(0.3276)) and r.cap == 3.0 and r.none is None
    assert np.isclose(r.k, 0.4 * 0.1 * 0.8) and r.novar == 0.0 and r.costly == 0.0 and r.capped == 1.0 and (r.low, r.ok) == (0.0, 0.5)


def test_atr_stop_trails_only_in_profit(spark):
    prices = [100, 99, 98.5, 103, 101.4]
    rows = [(1, D(2024, 1, 1, i), float(p), 1.0, 100.0, 1.0, 1) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "trade int, t timestamp_ntz, price double, atr double, entry_price double, entry_atr double, side int")
    out = exits.atr_stop(df, trade=["trade"], time="t").orderBy("t").collect()
    assert [r.exit for r in out] == [False, False, False, False, True] and out[4].stop == 101.5


def test_calibration_pieces(spark):
    rows = [(i, 0, [2.0, 1.0, 0.0], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, fold long, logits array<double>, label long")
    p = K.with_scores(K.probabilities(df, 1.0))
    r = p.filter("row_id = 1").first()
    assert r.score == pytest.approx(1 - r.probs[1] + 0.01)
    q = K.fit_quantiles(p, ["fold"])
    assert q.count() == 3
    covered = K.with_sets(p, q, ["fold"]).agg(F.avg(C("covered").cast("double"))).first()[0]
    assert covered >= 0.9
    t = K.fit_temperature(df, ["fold"]).first().temperature
    assert t == 3.0  # labels are independent of the scores: as flat as allowed


def test_contracts(spark, tmp_path):
    c = contracts.CONTRACTS["vintages"]
    assert c.key == ("series_id", "date", "realtime_start")
    rows = [("a", D(2024, 1, 1), D(2024, 1, 2), 1.0, D(2024, 1, 2), D(2024, 1, 3))]
    good = spark.createDataFrame(rows, c.schema)
    with pytest.raises(ValueError, match="repeated key series_id, date, realtime_start: 1 keys"):
        contracts.validate(good.unionByName(good), c)
    assert contracts.validate(good, c).count() == 1
    late = good.withColumn("t_visible", F.lit(D(2024, 1, 1)).cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="release_ts > t_visible: 1 rows"):
        contracts.validate(late, c)
    with pytest.raises(ValueError, match="missing column value"):
        contracts.validate(good.drop("value"), c)
    with pytest.raises(ValueError, match="expected double"):
        contracts.validate(good.withColumn("value", C("value").cast("string")), c)
    with pytest.raises(ValueError, match="null series_id"):
        contracts.validate(good.withColumn("series_id", F.lit(None).cast("string")), c)
    assert contracts.shape_violations(good.withColumn("x", F.lit(1)), c, allow_extra=False) == ["extra column x"]
    assert contracts.read_or_empty(spark, c, str(tmp_path / "nothing")).count() == 0
    contracts.write_validated(good, c, str(tmp_path / "v"), partition_by=["series_id"])
    assert contracts.read_or_empty(spark, c, str(tmp_path / "v"), str(tmp_path / "nothing")).count() == 1


def test_build_driver(spark, tmp_path):
    reg = builds.Registry()
    c = contracts.Contract.of("t", "a long", ["a"])

    @reg.source("good", c)
    def good(s):
        return s.range(3).select(C("id").alias("a"))

    @reg.source("bad", c)
    def bad(s):
        return s.range(3)

    first = builds.build(spark, reg, str(tmp_path))
    assert first["good"] == "built" and first["bad"].startswith("failed")
    assert builds.build(spark, reg, str(tmp_path))["good"] == "skipped"


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, D(2024, 1, 1)), (2, None, D(2024, 1, 2))], "a long, b double, t timestamp_ntz")
    digest = lambda d: snapshot.fingerprint(d).first().digest
    base = digest(df)
    assert base == digest(df.orderBy(C("a").desc())) == digest(df.repartition(3))
    assert base != digest(df.withColumn("b", C("b") + 1)) and base != digest(df.withColumnRenamed("b", "c"))
    assert base != digest(df.withColumn("a", C("a").cast("int")))
    path = snapshot.write_snapshot(df, str(tmp_path), "v1", time="t")
    assert base in path and spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="exist"):
        snapshot.write_snapshot(df, str(tmp_path), "v1", time="t")
    root = str(tmp_path / "pub")
    snapshot.publish(df, root, "1")
    snapshot.publish(df.limit(1), root, "2")
    assert snapshot.read_current(spark, root).count() == 1
    files = snapshot.integrity_manifest(spark, f"{path}/*.parquet")
    assert snapshot.verify_manifest(files, files).count() == 0
    wrong = files.withColumn("sha256", F.lit("0"))
    assert {r.state for r in snapshot.verify_manifest(wrong, files).collect()} == {"changed"}


def test_ingest(spark):
    raw = spark.createDataFrame([(" gld ", "1705327200000", "1.5", "x")], "s string, t string, o string, c string")
    bar = ingest.conform_bars(raw, symbol="s", epoch_ms="t", fields={"open": "o", "close": "c"}).first()
    assert (bar.symbol, bar.timestamp, bar.open, bar.close) == ("GLD", D(2024, 1, 15, 14, 0), 1.5, None)
    assert bar.t_visible == D(2024, 1, 15, 14, 30)
    q = one(spark, ingest.quarter_start(F.lit("Q3 2001")).alias("a"), ingest.quarter_start(F.lit("World")).alias("b"))
    assert q.a == D(2001, 7, 1) and q.b is None
    wide = spark.createDataFrame([(1, "2", "n/a"), (2, None, "4.5")], "d int, a string, b string")
    long = ingest.melt_numeric(wide, ["d"], ["a", "b"])
    assert sorted((r.d, r.series, r.value) for r in long.collect()) == [(1, "a", 2.0), (2, "b", 4.5)]
    v = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 6.0)], "k string, r int, v double")
    assert latest_by(v, ["k"], order=["r"]).first().v == 6.0


def test_html_fallbacks(spark):
    page = '<html><head><meta property="og:title" content="Meta"/></head><body><p>one</p><p>two &amp; three</p><time datetime="2024-02-03T04:05:06Z"></time></body></html>'
    r = one(spark, X.html_title(F.lit(page)).alias("t"), X.html_body(F.lit(page)).alias("b"), X.html_published(F.lit(page)).alias("p"))
    assert (r.t, r.b, r.p) == ("Meta", "one two & three", "2024-02-03T04:05:06Z")
    u = lambda h: X.resolve_url(F.lit("https://a.b/c/d?x=1"), F.lit(h))
    r = one(spark, u("/e").alias("x"), u("e").alias("y"), u("http://z/q").alias("z"))
    assert (r.x, r.y, r.z) == ("https://a.b/e", "https://a.b/c/e", "http://z/q")
    k = one(spark, X.has_keyword(F.lit("All GOLD!"), ["gold"]).alias("a"), X.has_keyword(F.lit("golden"), ["gold"]).alias("b"))
    assert k.a and not k.b
    names = ["gld_atr_14", "regime_x", "is_fomc_week", "news_n", "dgs10_level", "spread_10y_2y", "foo"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(X.feature_category(C("n")).alias("c"))
    assert [r.c for r in df.collect()] == ["volatility", "regime", "calendar", "news", "macro", "rates", "other"]
