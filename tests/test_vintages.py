"""Series as known at many instants against a plain lookup."""

import datetime as dt
import random

from pitspark.operators.vintages import as_known_at_rows

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def test_late_releases_and_revisions(spark):
    rng = random.Random(4)
    vintages, seen = [], set()
    for s in ("a", "b", None):
        for d in range(40):
            for _ in range(rng.randrange(1, 4)):  # releases out of order, several revisions, some at one instant
                start = T0 + (d + rng.randrange(1, 9)) * DAY + dt.timedelta(hours=rng.choice((0, 12)))
                if (s, d, start) not in seen:
                    seen.add((s, d, start))
                    vintages.append((s, T0 + 30 * d * DAY, start, None if rng.random() < 0.1 else rng.random()))
    rows = [(s, T0 + dt.timedelta(hours=6 * i)) for s in ("a", "b", None, "none") for i in range(-2, 220)]
    left = spark.createDataFrame(rows, "s string, t timestamp_ntz")
    right = spark.createDataFrame(vintages, "s string, date timestamp_ntz, realtime_start timestamp_ntz, value double")
    out = as_known_at_rows(left, right, left_time="t", by=["s"], lags=(0, 1, 3), bucket_seconds=5 * 86_400)
    got = {(r.s, r.t): r for r in out.collect()}
    assert len(got) == len(rows)
    for s, t in rows:
        known = [v for v in vintages if v[0] == s and v[2] <= t and s is not None]  # a null key matches nothing
        dates = sorted({v[1] for v in vintages if v[0] == s})
        r = got[s, t]
        for k in (0, 1, 3):
            at = dates.index(max(v[1] for v in known)) - k if known else -1
            obs = dates[at] if at >= 0 else None
            own = [v for v in known if v[1] == obs]
            assert (r[f"obs_{k}"], r[f"value_{k}"]) == (obs, max(own, key=lambda v: v[2])[3] if own else None), (s, t, k)
