"""Runs every registered query against its SQL on the same tables: python -m gatelight.catalog.check DIR [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from gatelight.catalog import load
from gatelight.session import local_session

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, entry):
    started = time.time()
    df = entry.run(spark, sf_dir)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if entry.sql is None:
        return took, len(got[1]), None, ""
    started = time.time()
    rel = con.sql(entry.sql)
    want = table_of(rel.columns, rel.fetchall())
    sql_took = time.time() - started
    note = ""
    if got[0] != want[0]:
        note = f"columns {got[0]} / {want[0]}"
    elif got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        lack = [r for r in want[1] if r not in set(got[1])][:2]
        note = f"rows {len(got[1])} / {len(want[1])}\n   spark only {str(extra)[:900]}\n   sql only   {str(lack)[:900]}"
    return took, len(got[1]), sql_took, note


def main(argv: list[str]) -> int:
    sf_dir, names = argv[0], argv[1:]
    queries = load()
    spark, con, bad = local_session(cores=os.environ.get("BENCH_CPUS", "8")), connect(argv[0]), 0
    for name, entry in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            took, rows, sql_took, note = compare(spark, con, sf_dir, name, entry)
        except Exception as error:  # one broken query must not hide the others
            took, rows, sql_took, note = 0.0, -1, None, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(note)
        kind = "  " if sql_took is not None else "r "
        print(f"{'BAD' if note else 'ok '} {kind}{name:34s} rows {rows:7d} spark {took:6.2f}s sql {sql_took or 0:5.2f}s {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
