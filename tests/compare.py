"""Run registered queries against their SQL counterparts in DuckDB.

``python tests/compare.py [folder] [name ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import pathlib
import signal
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return connection


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_cell(v) for v in table.column(name).to_pylist()] for name in names]
    return sorted(zip(*columns)) if columns else []


def compare(spark, connection, folder: str, name: str, build, sql: str) -> tuple[str, float, float]:
    started = time.time()
    mine = build(spark, folder).toArrow()
    spark_seconds = time.time() - started
    started = time.time()
    connection.execute(sql)
    names = [column[0] for column in connection.description]
    fetched = connection.fetchall()
    sql_seconds = time.time() - started
    if sorted(mine.column_names) != sorted(names):
        return f"columns {sorted(set(mine.column_names) ^ set(names))}", spark_seconds, sql_seconds
    left = _rows(mine)
    places = [names.index(name) for name in sorted(names)]
    right = sorted(tuple(_cell(row[place]) for place in places) for row in fetched)
    if left == right:
        return f"ok {len(left)} rows", spark_seconds, sql_seconds
    first = next((pair for pair in zip(left, right) if pair[0] != pair[1]), "length")
    differing = sum(1 for a, b in zip(left, right) if a != b)
    return f"DIFF rows {len(left)}/{len(right)} differing {differing} first {first}", spark_seconds, sql_seconds


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from furlong.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    oracles = oracle_sql()

    def give_up(signum, frame):
        print("\n@@ gave up on the query after", names_done, flush=True)
        os._exit(1)

    signal.signal(signal.SIGALRM, give_up)
    names_done = None
    for name, build in queries().items():
        if names and name not in names:
            continue
        signal.alarm(150)
        try:
            outcome, a, b = compare(spark, connection, folder, name, build, oracles[name])
        except Exception as failure:  # the report goes on with the next query
            outcome, a, b = f"FAILED {str(failure)[:1500]}", 0, 0
        names_done = name
        print(f"\n@@ {name}: {outcome} [{a:.1f}s / {b:.1f}s]", flush=True)


if __name__ == "__main__":
    main()
