"""Run a query on Spark and its SQL on a second engine and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import time

import duckdb


def engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def kind(name: str) -> str:
    low = name.lower()
    if any(k in low for k in ("int", "long", "short")):
        return "int"
    for k in ("double", "float", "decimal", "varchar", "string", "bool", "timestamp", "date"):
        if k in low:
            return {"varchar": "string", "float": "double"}.get(k, k)
    return low


def compare(df, con, sql: str) -> tuple[bool, str]:
    names, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return False, f"columns {names} != {want_names}"
    types = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    other = {d[0]: kind(str(d[1])) for d in cur.description}
    odd = {n: (types[n], other[n]) for n in names if types[n] != other[n]}
    if got != want:
        extra = [r for r in got if r not in set(want)][:2] if len(want) < 5000 else []
        miss = [r for r in want if r not in set(got)][:2] if len(want) < 5000 else []
        return False, f"rows {len(got)} vs {len(want)}; spark only {str(extra)[:600]}; sql only {str(miss)[:600]}"
    return True, f"{len(got)} rows" + (f" TYPES {odd}" if odd else "")


def run_all(spark, sf_dir: str, only=None) -> dict[str, str]:
    import __spark_entry__ as e

    con, bad = engine(sf_dir), {}
    oracles = e.oracle_sql()
    for name, fn in e.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            built = time.time() - t
            if name in oracles:
                ok, note = compare(df, con, oracles[name])
            else:
                ok, note = True, f"{len(df.collect())} rows, no SQL"
        except Exception as failure:
            ok, note, built = False, f"{type(failure).__name__}: {str(failure)[:700]}", 0
        print(("ok  " if ok else "FAIL"), name, f"{time.time() - t:.2f}s (build {built:.2f})", note, flush=True)
        if not ok:
            bad[name] = note
    return bad


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    failed = run_all(session, sys.argv[1], set(sys.argv[2].split(",")) if len(sys.argv) > 2 else None)
    print("failed:", sorted(failed))
