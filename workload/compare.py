"""Run registered queries beside their DuckDB twins and report differences.

    python -m workload.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from liftgrid.session import build_session
from workload import oracles, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _canonical(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(0.0 if value == 0 else value)
    return str(value)


def canonical_rows(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_canonical(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, sf_dir: str, name: str, connection=None) -> str | None:
    """None when both sides agree, else a description of the difference."""
    connection = connection or connect(sf_dir)
    frame = queries.all_queries()[name](spark, sf_dir)
    ours = frame.collect()
    cursor = connection.execute(oracles.all_oracles()[name])
    columns = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    duck = {c[0]: str(c[1]) for c in cursor.description}
    allowed = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    }
    wrong = {c: (kinds[c], duck[c]) for c in columns if allowed.get(kinds[c]) != duck[c]}
    if wrong:
        return f"types {wrong}"
    left = canonical_rows(frame.columns, ours)
    right = canonical_rows(columns, theirs)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        return f"{len(different)} of {len(left)} rows differ, first {different[0]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        "compare",
        **{
            "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failures = 0
    for name in names or sorted(oracles.all_oracles()):
        start = time.time()
        try:
            problem = compare(spark, sf_dir, name, connection)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
