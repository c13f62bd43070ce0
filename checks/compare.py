"""Run each query in Spark and DuckDB and compare rows.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def _plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        rows.append(
            tuple(
                None
                if value is None or value is pd.NA or (isinstance(value, float) and value != value)
                else value.item()
                if hasattr(value, "item")
                else value
                for value in row
            )
        )
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def difference(name: str, spark: SparkSession, connection, sf: str) -> str | None:
    """What differs between the two results, or None."""
    result = QUERIES[name](spark, sf)
    # As objects: pandas would turn whole numbers with a null among them to floats.
    ours = pd.DataFrame([tuple(row) for row in result.collect()], columns=result.columns, dtype=object)
    if name not in ORACLE:
        return None if len(ours) else "no rows"
    relation = connection.sql(ORACLE[name])
    theirs = relation.df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    types = {c: TYPES[str(t)] for c, t in zip(relation.columns, relation.types)}
    off = [(c, t, types[c]) for c, t in result.dtypes if t != types[c]]
    if off:
        return f"types {off}"
    left, right = _plain(ours), _plain(theirs)
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    if not left:
        return "no rows"
    for a, b in zip(left, right):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"{a!r:.300} and {b!r:.300}"
    return None


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            found = difference(name, spark, connection, sf)
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
