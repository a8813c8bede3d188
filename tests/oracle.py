"""Compare a registered query with its SQL, as sorted columns and unordered rows."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normalized(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=repr)


def spark_result(df):
    return normalized(df.columns, df.collect())


def sql_result(con, sql: str):
    cursor = con.execute(sql)
    return normalized([d[0] for d in cursor.description], cursor.fetchall())


def differences(df, con, sql: str, limit: int = 5) -> str | None:
    """None if equal, else a short account of what differs."""
    names, rows = spark_result(df)
    sql_names, sql_rows = sql_result(con, sql)
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    if rows == sql_rows:
        return None
    ours, theirs = set(rows), set(sql_rows)
    return (
        f"{len(rows)} rows, SQL {len(sql_rows)}; only ours {len(ours - theirs)}:"
        f" {sorted(ours - theirs, key=repr)[:limit]}; only SQL {len(theirs - ours)}:"
        f" {sorted(theirs - ours, key=repr)[:limit]}"
    )
