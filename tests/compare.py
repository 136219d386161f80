"""Compares a Spark result with DuckDB's on the same tables, regardless of row order."""

from __future__ import annotations

import datetime
import decimal
import os


def connect(folder: str):  # noqa: ANN201
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def plain(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 6))
    if isinstance(value, datetime.datetime):
        return str(value.astimezone(datetime.timezone.utc).replace(tzinfo=None) if value.tzinfo else value)
    return repr(value)


def rows_of(table) -> tuple[list[str], list[tuple]]:  # noqa: ANN001
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(map(plain, r)) for r in zip(*columns))


def same(df, sql: str, con) -> None:  # noqa: ANN001
    ours, theirs = rows_of(df.toArrow()), rows_of(con.sql(sql).to_arrow_table())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
