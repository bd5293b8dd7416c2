"""Compare registered queries with their SQL twins: python -m tests.oracle [sf] [name…]"""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = "/root/testdata"


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{ROOT}/{sf}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v)
    if isinstance(v, (bytearray, bytes)):
        return bytes(v).hex()
    if isinstance(v, decimal.Decimal):
        return str(v)
    return repr(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name, query, sql, sf):
    start = time.time()
    df = query(spark, f"{ROOT}/{sf}")
    got, got_cols = normal(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return None, f"{len(got)} rows, no SQL", took
    cur = con.execute(sql)
    want, want_cols = normal([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", took
    if got != want:
        gs, ws = set(got), set(want)
        return False, f"{len(got)} vs {len(want)} rows; only spark {sorted(gs - ws)[:3]}; only sql {sorted(ws - gs)[:3]}", took
    return True, f"{len(got)} rows", took


def main():
    import __spark_entry__ as entry
    from fleetfold.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    only = sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf)
    bad = 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, query in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            ok, note, took = compare(spark, con, name, query, oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        bad += ok is False
        print(f"{'ok  ' if ok else '--  ' if ok is None else 'FAIL'} {took:6.2f}s {name}: {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
