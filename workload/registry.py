"""The query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name; ``sql`` is what DuckDB must agree with."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame) -> DataFrame:
    """A short sorted report with its order made visible; its few rows come by the driver."""
    rows = [(*row, place) for place, row in enumerate(df.collect(), start=1)]
    return df.sparkSession.createDataFrame(rows, T.StructType([*df.schema.fields, T.StructField("rank", T.LongType())]))
