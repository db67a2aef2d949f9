"""Compare every query with its SQL on the same tables: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def differences(df, con, sql: str) -> str:
    """Empty where rows, names and values agree."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    kinds = {n: str(t) for n, t in zip(names, [d[1] for d in want.description])}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    order = sorted(names)
    expected = Counter(tuple(row[names.index(n)] for n in order) for row in want.fetchall())
    found = Counter(tuple(row[n] for n in order) for row in df.select(*order).collect())
    types = {n: (t, kinds[n]) for n, t in df.dtypes}
    loose = {n: p for n, p in types.items() if {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR",
             "boolean": "BOOLEAN"}.get(p[0]) not in (p[1], None)}
    if expected != found:
        more, less = list((found - expected).items())[:3], list((expected - found).items())[:3]
        return f"{sum(found.values())} / {sum(expected.values())} rows; {order}\n   spark {more}\n   sql   {less}"
    return f"types {loose}" if loose else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from rowwarden.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                          "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf_dir), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            verdict = differences(fn(spark, sf_dir), con, oracles[name]) if name in oracles else "no sql"
        except Exception as problem:  # report and go on with the next query
            verdict = f"{type(problem).__name__}: {str(problem)[:600]}"
        print(f"{'ok  ' if not verdict else 'FAIL'} {name} {time.time() - began:.1f}s {verdict}", flush=True)
