"""Run queries beside their DuckDB checks and compare row by row.

    python tests/check.py [--sf DIR] [--time] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(partitions: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)) if v is None else "", v if v is not None else 0) if not isinstance(v, float) or not math.isnan(v) else (True, "nan", 0) for v in row)


def compare(spark, con, name: str, sf: str) -> tuple[str, int]:
    from verilens.plans.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=_key)
    if name not in ORACLES:
        return ("rows" if got else "EMPTY"), len(got)
    rel = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})")
    want = sorted(rel.fetchall(), key=_key)
    if not want:
        return "EMPTY", len(got)
    if len(got) != len(want):
        return f"ROWS {len(got)} <> {len(want)} got {got[:2]} want {want[:2]}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"VALUES {len(bad)} of {len(got)} differ in {cols}: {bad[:3]}", len(got)
    return "ok", len(got)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module", default="")
    a = ap.parse_args()
    from verilens.plans.catalog import QUERIES

    spark, con = session(), duck(a.sf)
    spark.sparkContext.setLogLevel("ERROR")
    names = a.names or list(QUERIES)
    failed = 0
    for n in names:
        t = time.time()
        try:
            status, rows = compare(spark, con, n, a.sf)
        except Exception as e:  # noqa: BLE001
            status, rows = "ERROR " + str(e)[:1500], -1
        good = status in ("ok", "rows")
        failed += not good
        print(f"{'PASS' if good else 'FAIL'} {n} rows={rows} {time.time() - t:.1f}s {'' if status == 'ok' else status}", flush=True)
    print(f"{len(names) - failed}/{len(names)} passed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
