"""Running a query and its SQL oracle side by side."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Spark type -> DuckDB type of the same values.
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(folder, f"{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{path}')")
    return con


def _sortable(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between a frame and an oracle: columns, types or rows."""
    rel = con.sql(sql)
    names = sorted(spark_df.columns)
    if names != sorted(rel.columns):
        return [f"columns {names} != {sorted(rel.columns)}"]
    found = []
    theirs = dict(zip(rel.columns, (str(t) for t in rel.types)))
    for name, dtype in spark_df.dtypes:
        if SAME_TYPE.get(dtype) != theirs[name]:
            found.append(f"type of {name}: {dtype} vs {theirs[name]}")
    ours = sorted((tuple(r) for r in spark_df.select(*names).collect()), key=_sortable)
    quoted = ", ".join(f'"{n}"' for n in names)
    other = sorted(rel.project(quoted).fetchall(), key=_sortable)
    if len(ours) != len(other):
        found.append(f"rows {len(ours)} != {len(other)}")
    for a, b in zip(ours, other):
        if a != b:
            found.append(f"first difference in {names}:\n  spark  {a}\n  oracle {b}")
            break
    return found
