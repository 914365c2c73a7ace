"""Runs a registered query and its SQL counterpart on the same files and compares them."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    spark_columns = list(df.columns)
    got = rows_of(spark_columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(spark_columns):
        return f"columns {sorted(spark_columns)} against {sorted(columns)}"
    want = rows_of(columns, cursor.fetchall())
    if got != want:
        extra, lacking = got - want, want - got
        return (
            f"rows {sum(got.values())} against {sum(want.values())}; "
            f"{sum(extra.values())} differ, such as {list(extra)[:2]} against {list(lacking)[:2]}"
        )
    types = {d[0]: str(d[1]) for d in cursor.description}
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    known = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "tinyint": "TINYINT", "boolean": "BOOLEAN",
    }
    off = {c: (t, types[c]) for c, t in spark_types.items() if known.get(t) != types[c]}
    return f"types {off}" if off else None


if __name__ == "__main__":
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tests.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    oracle = entry.oracle_sql()
    failures = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, fn, oracle[name]) if name in oracle else "no SQL"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failures += problem is not None
        print(f"{time.time() - start:6.2f}s {name}: {problem or 'ok'}", flush=True)
    print("failures", failures)
