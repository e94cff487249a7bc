"""Run registered queries in Spark and in DuckDB and compare row multisets.

    python -m checks.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import collections
import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_cell(item) for item in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), collections.Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def open_tables(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    frame = query(spark, sf_dir)
    names, got = rows_of(frame.columns, frame.collect())
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    oracle_names, want = rows_of([column[0] for column in result.description], result.fetchall())
    if names != oracle_names:
        return f"columns {names} <> {oracle_names}"
    if got != want:
        only, lack = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"rows {sum(got.values())} <> {sum(want.values())}; only spark {only}; only sql {lack}"
    return None


def main():
    from checks import registry
    from tidemark.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    chosen = parser.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(chosen.sf)
    failed = 0
    for name in chosen.names or registry.QUERIES:
        begin = time.time()
        try:
            problem = compare(spark, con, registry.QUERIES[name], registry.SQL.get(name), chosen.sf)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "" if name in registry.SQL else " (no sql)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{kind} {time.time() - begin:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
