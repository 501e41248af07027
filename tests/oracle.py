"""Compare queries with DuckDB on the same Parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, connection, sql: str) -> list[str]:
    """Differences, none when the results agree."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = rows_of(names, cursor.fetchall())
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    for field in df.schema.fields:
        if kinds[field.name] in ("HUGEINT",) or kinds[field.name].startswith("DECIMAL"):
            problems.append(f"{field.name}: {kinds[field.name]} in SQL, {field.dataType.simpleString()} here")
    got = rows_of(df.columns, df.collect())
    if got != expected:
        only_spark, only_sql = got - expected, expected - got
        problems.append(
            f"{sum(got.values())} rows instead of {sum(expected.values())}; "
            f"only here {list(only_spark)[:3]}; only in SQL {list(only_sql)[:3]}"
        )
    return problems
