"""Catalog table writers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tableloom.sinks.files import CODECS, together
from tableloom.staging import path_exists

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}")


@dataclass(frozen=True)
class TableTarget:
    """A managed table, or an external one when ``location`` is set.

    ``drop`` removes the old table first, ``truncate`` keeps its schema and replaces its
    rows, ``overwrite`` replaces both; with none of them rows are appended by name. Without
    ``overwrite`` a location that holds data but belongs to no table is refused.
    """

    name: str
    format: str = "parquet"
    location: str | None = None
    partition_by: Sequence[str] = field(default_factory=tuple)
    overwrite: bool = True
    truncate: bool = False
    drop: bool = False
    codec: str | None = None
    field_delimiter: str = ","
    line_delimiter: str | None = None

    @classmethod
    def from_options(cls, options: Mapping[str, Any]) -> "TableTarget":
        """From job options; empty text means the default."""
        get = options.get
        return cls(
            name=get("table_name", ""),
            format=get("format") or "parquet",
            location=get("table_location") if get("external") else None,
            partition_by=[get("partition_col")] if get("partition_col") else (),
            overwrite=get("overwrite", True),
            truncate=get("truncate", False),
            drop=get("drop", False),
            codec=get("compression") or None,
            field_delimiter=get("field_delimiter") or ",",
            line_delimiter=get("line_delimiter") or None,
        )

    def check(self) -> None:
        if not _NAME.fullmatch(self.name or ""):
            raise ValueError(f"bad table name {self.name!r}")
        if self.format not in CODECS:
            raise ValueError(f"unknown format {self.format!r}")
        if self.codec and self.codec.lower() not in CODECS[self.format]:
            raise ValueError(f"{self.format} has no codec {self.codec!r}")


def guard_table(spark: SparkSession, target: TableTarget) -> None:
    """Refuse a bad or taken target before any data is read."""
    target.check()
    known = spark.catalog.tableExists(target.name)
    if target.location and not known and not target.overwrite and path_exists(spark, target.location):
        raise FileExistsError(f"target exists and is no table of this name: {target.location}")


def write_table(df: DataFrame, target: TableTarget) -> DataFrame:
    """Write and return the table."""
    spark = df.sparkSession
    guard_table(spark, target)
    if target.drop:
        spark.sql(f"DROP TABLE IF EXISTS {target.name}")
    keep_table = target.truncate or not target.overwrite
    if keep_table and spark.catalog.tableExists(target.name):
        # insertInto goes by position, so the columns are put in the table's order.
        rows = together(df.select(*spark.table(target.name).columns), target.partition_by)
        rows.write.insertInto(target.name, overwrite=target.truncate)
        return spark.table(target.name)
    mode = "overwrite" if target.overwrite else "errorifexists"
    writer = together(df, target.partition_by).write.format(target.format).mode(mode)
    if target.location:
        writer = writer.option("path", target.location)
    if target.codec:
        writer = writer.option("compression", target.codec)
    if target.format == "csv":
        writer = writer.option("sep", target.field_delimiter)
        if target.line_delimiter:
            writer = writer.option("lineSep", target.line_delimiter)
    if target.partition_by:
        writer = writer.partitionBy(*target.partition_by)
    writer.saveAsTable(target.name)
    return spark.table(target.name)


def create_text_table(
    spark: SparkSession, name: str, columns: str, location: str, delimiter: str = ","
) -> DataFrame:
    """A table over delimited text files that are already there; nothing is copied."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"bad table name {name!r}")
    quoted = {"sep": delimiter, "path": location}
    options = ", ".join("'{}' = '{}'".format(k, v.replace("\\", "\\\\").replace("'", "\\'")) for k, v in quoted.items())
    spark.sql(f"CREATE TABLE {name} ({columns}) USING csv OPTIONS ({options})")
    return spark.table(name)
