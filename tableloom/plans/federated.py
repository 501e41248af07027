"""User SQL over two sources of different kinds."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tableloom.functions.decode import decode_positional, split_rejects
from tableloom.functions.schema import import_schema
from tableloom.operators.joins import dedupe_columns
from tableloom.sinks.files import FileTarget, guard, write_files
from tableloom.sinks.report import RunReport, write_with_report
from tableloom.sinks.tables import TableTarget, guard_table, write_table
from tableloom.sinks.topics import publish_kafka
from tableloom.sources.catalog import read_table
from tableloom.sources.files import read_csv, read_parquet
from tableloom.sources.jdbc import JdbcSource, read_jdbc
from tableloom.sources.topics import KafkaTopic
from tableloom.streaming.drain import Drain, drain, drain_all


@dataclass(frozen=True)
class Source:
    """A source by type: csv, parquet, jdbc, table, frame or stream.

    ``at`` is the path, the table name, a ``JdbcSource``, a frame or a streaming frame of
    messages. A stream with a ``schema`` descriptor carries JSON arrays in ``value``; its
    rejected rows fail the job unless ``ignore_rejects``, and are then counted in its report.
    """

    type: str
    at: Any
    schema: Any = None
    options: dict[str, Any] = field(default_factory=dict)
    ignore_rejects: bool = False


# Rejected rows of the sources read so far, each with its errors.
Rejects = list[DataFrame]
Target = FileTarget | TableTarget | KafkaTopic


def read_source(spark: SparkSession, source: Source, rejects: Rejects | None = None) -> DataFrame:
    """The rows of a source; what it rejects is appended to ``rejects``."""
    if source.type == "csv":
        return read_csv(spark, source.at, source.schema, **source.options)
    if source.type == "parquet":
        return read_parquet(spark, source.at)
    if source.type == "table":
        return read_table(spark, source.at)
    if source.type == "jdbc":
        at = source.at if isinstance(source.at, JdbcSource) else JdbcSource(**source.at)
        return read_jdbc(spark, at)
    if source.type == "frame":
        return source.at
    if source.type == "stream":
        return _drained(source, rejects)
    raise ValueError(f"unknown source type {source.type!r}")


def _drained(source: Source, rejects: Rejects | None) -> DataFrame:
    if source.schema is None:
        return drain(source.at, **source.options)
    specs = import_schema(source.schema)
    return _accepted(source, drain(source.at, lambda s: decode_positional(s, specs), **source.options), rejects)


def _accepted(source: Source, rows: DataFrame, rejects: Rejects | None) -> DataFrame:
    good, bad = split_rejects(rows)
    if not source.ignore_rejects:
        if not bad.isEmpty():
            raise ValueError("the stream has messages that do not fit their schema")
    elif rejects is not None:
        rejects.append(bad)
    return good


def read_sources(spark: SparkSession, sources: Sequence[Source], rejects: Rejects | None = None) -> list[DataFrame]:
    """All sources; streams drain side by side."""
    streams = [s for s in sources if s.type == "stream" and s.schema is not None and not s.options]
    decoded = drain_all(
        [Drain(s.at, lambda d, specs=import_schema(s.schema): decode_positional(d, specs)) for s in streams]
    )
    drained = {id(s): _accepted(s, rows, rejects) for s, rows in zip(streams, decoded)}
    return [drained[id(s)] if id(s) in drained else read_source(spark, s, rejects) for s in sources]


def guard_target(spark: SparkSession, target: Target) -> None:
    """Refuse a bad or taken target before any data is read."""
    if isinstance(target, FileTarget):
        guard(spark, target)
    elif isinstance(target, TableTarget):
        guard_table(spark, target)
    else:
        target.sink_options()


def write_target(df: DataFrame, target: Target) -> None:
    """Files, a table, or one JSON message per row to a topic."""
    if isinstance(target, FileTarget):
        write_files(df, target)
    elif isinstance(target, TableTarget):
        write_table(df, target)
    else:
        publish_kafka(df, target)


def rejected(rejects: Rejects) -> int:
    """How many rows the sources turned away; they lie in drained tables."""
    return sum(df.count() for df in rejects)


def sql_join(left: DataFrame, right: DataFrame, query: str, repair: str = "suffix") -> DataFrame:
    """Run ``query`` over the names ``left`` and ``right``; column names come out unique.

    The views behind the two names are private to the call.
    """
    spark = left.sparkSession
    names = {side: f"{side}_{uuid.uuid4().hex}" for side in ("left", "right")}
    left.createOrReplaceTempView(names["left"])
    right.createOrReplaceTempView(names["right"])
    try:
        bound = ", ".join(f"`{side}` AS (SELECT * FROM {view})" for side, view in names.items())
        result = spark.sql(f"WITH {bound} SELECT * FROM (\n{query.rstrip().rstrip(';')}\n)")
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)
    return dedupe_columns(result, repair)


def federated_sql(
    spark: SparkSession,
    left: Source,
    right: Source,
    query: str,
    repair: str = "suffix",
    rejects: Rejects | None = None,
) -> DataFrame:
    return sql_join(*read_sources(spark, [left, right], rejects), query, repair)


def run_sql(spark: SparkSession, left: Source, right: Source, query: str, target: Target) -> RunReport:
    """Check the target, run the query, write, report what was written and rejected."""
    guard_target(spark, target)
    rejects: Rejects = []
    result = federated_sql(spark, left, right, query, rejects=rejects)
    return write_with_report(result, lambda df: write_target(df, target), rejected=rejected(rejects))
