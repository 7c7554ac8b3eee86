"""Run a registered query and its SQL check side by side and compare."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return f"date:{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return f"{type(v).__name__}:{v}"


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str, float]:
    from pitspark.plans import catalogue

    start = time.time()
    df = catalogue.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if name not in catalogue.ORACLES:
        return len(rows) > 0, f"rows only ({len(rows)}) {[f.simpleString() for f in df.schema][:12]}", took
    res = con.execute(catalogue.ORACLES[name])
    cols = [d[0] for d in res.description]
    types = [str(d[1]) for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}", took
    order = sorted(cols)
    got_c = Counter(tuple(norm(r[c]) for c in order) for r in rows)
    ix = [cols.index(c) for c in order]
    want_c = Counter(tuple(norm(r[i]) for i in ix) for r in want)
    if got_c == want_c:
        if not rows:
            return False, "EMPTY result on both sides", took
        return True, f"{len(rows)} rows", took
    missing, extra = want_c - got_c, got_c - want_c
    msg = [f"rows {len(rows)} vs {len(want)}; {sum(extra.values())} extra, {sum(missing.values())} missing; {order}"]
    msg += [f"   spark {x}" for x in sorted(extra, key=str)[:3]]
    msg += [f"   duck  {x}" for x in sorted(missing, key=str)[:3]]
    msg.append(f"   types {[f.dataType.simpleString() for f in df.schema]} {types}")
    return False, "\n".join(msg)[:2500], took


def main() -> int:
    import argparse

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--module", default=None, nargs="*", help="only queries of these plans modules")
    args = ap.parse_args()
    from pitspark.plans import catalogue
    from pitspark.session import build_session

    spark = build_session(
        "check",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duck(sf_dir)
    names = args.names or [n for n in catalogue.QUERIES if not args.module]
    names += [n for n in catalogue.QUERIES if args.module and catalogue.MODULE_OF[n] in args.module]
    bad = 0
    for n in names:
        try:
            ok, msg, took = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on with the other queries
            ok, msg, took = False, f"{type(e).__name__}: {str(e)[:1200]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} {took:.2f}s {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
