"""Runs registered queries next to their SQL twins and reports differences.

    python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), sorted(columns)


def compare(df, sql, con) -> str:
    """Empty string when columns, types class and every value agree."""
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}" if bad else ""


def main(argv):
    from riskloom.plans import ORACLES, QUERIES
    from riskloom.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con, failed = local_session("8"), connect(sf_dir), 0
    limit = float(os.environ.get("QUERY_SECONDS", "120"))
    for name, run in QUERIES.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
        watch = threading.Timer(limit, spark.sparkContext.cancelJobGroup, [name])
        watch.start()
        try:
            if name in ORACLES:
                verdict = compare(run(spark, sf_dir), ORACLES[name], con)
            else:
                verdict = "" if run(spark, sf_dir).count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        watch.cancel()
        failed += bool(verdict)
        print(f"{'FAIL' if verdict else 'ok':5}{time.time() - start:6.1f}s {name} {verdict}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
