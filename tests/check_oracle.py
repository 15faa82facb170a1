"""Compare registered queries with their SQL, one line each.

    python tests/check_oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return [norm(v) for v in value]
    return value


def kind(value) -> str:
    return type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, query, sql):
    """(verdict, detail, seconds, rows)"""
    began = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - began
    if sql is None:
        return ("rows", "", took, len(got))
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return ("COLUMNS", f"{sorted(df.columns)} != {sorted(names)}", took, len(got))
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return ("COUNT", f"{len(a)} != {len(b)}", took, len(got))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return ("VALUES", f"{len(bad)} rows; spark {bad[0][0]} sql {bad[0][1]}", took, len(got))
    for x, y in zip(a, b):
        ka, kb = [kind(v) for v in x], [kind(v) for v in y]
        if ka != kb:
            return ("TYPES", f"{ka} {kb}", took, len(got))
    return ("ok", "", took, len(got))


def main():
    import __spark_entry__ as entry
    from cloudtally.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args.names or queries:
        try:
            verdict, detail, took, n = compare(spark, con, sf_dir, queries[name], oracle.get(name))
        except Exception as error:  # noqa: BLE001
            verdict, detail, took, n = "ERROR", str(error)[:900], 0, 0
        failed += verdict not in ("ok", "rows")
        print(f"{verdict:8} {name:34} rows={n:<6} {took:6.2f}s {detail}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
