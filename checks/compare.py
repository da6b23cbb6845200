"""Run queries and their SQL side by side: ``python -m checks.compare sf_dir [names]``."""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from pulse import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value):
    if isinstance(value, float) and value == 0:
        return 0.0  # -0.0
    return value.date() if isinstance(value, dt.datetime) else value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    """(equal, what was seen)."""
    started = time.time()
    made = QUERIES[name](spark, sf_dir)
    ours = rows_of(made.columns, made.collect())
    seconds = time.time() - started
    cursor = con.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(made.columns) != sorted(columns):
        return False, f"columns {sorted(made.columns)} / {sorted(columns)}"
    if ours != theirs:
        only = [next(iter(x.elements()), None) for x in (ours - theirs, theirs - ours)]
        return False, f"{ours.total()} / {theirs.total()} rows\n  {only[0]}\n  {only[1]}"
    return True, f"{ours.total()} rows, {seconds:.2f} s"


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def main() -> None:
    sf_dir, *names = sys.argv[1:]
    spark = build_session(
        master="local[8]",
        conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        equal, seen = compare(spark, con, sf_dir, name)
        failed += not equal
        print(f"{'ok  ' if equal else 'FAIL'} {name:28s} {seen}", flush=True)
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
