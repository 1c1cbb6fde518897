"""Compare a Spark result with its DuckDB twin, order-insensitively.

Run as a script to check queries by name prefix:
    python -m tests.compare sf0.01 semantic_edges knn
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    from lexweave.plans.registry import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int, float, float]:
    """('match' | 'rows-only' | text of the difference, rows, spark s, duckdb s)."""
    import __spark_entry__ as entry

    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spark_s = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(rows), spark_s, 0.0
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    other = cur.fetchall()
    duck_s = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(rows), spark_s, duck_s
    a, b = bag(df.columns, rows), bag(names, other)
    if a == b:
        return "match", len(rows), spark_s, duck_s
    left, right = list((a - b).items())[:3], list((b - a).items())[:3]
    return (
        f"DIFF {len(rows)} vs {len(other)}; cols {sorted(names)}; only spark {left}; only sql {right}",
        len(rows),
        spark_s,
        duck_s,
    )


def main() -> int:
    from lexweave.session import build_session

    sf_dir = f"{DATA}/{sys.argv[1]}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    con = connect(sf_dir)
    wanted = sys.argv[2:]
    bad = 0
    for name in entry.queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            result, rows, s, d = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on
            result, rows, s, d = f"ERROR {str(error)[:1500]}", -1, 0.0, 0.0
        if result not in ("match", "rows-only") or rows == 0:
            bad += 1
        print(f"{name:38s} rows={rows:<8d} spark={s:6.2f}s duck={d:5.2f}s {result}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
