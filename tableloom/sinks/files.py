"""File writers with checks that run before the job does."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from tableloom.staging import path_exists

# Codecs each format can be written with.
CODECS = {
    "csv": ("none", "uncompressed", "bzip2", "deflate", "gzip", "lz4", "snappy"),
    "parquet": ("none", "uncompressed", "gzip", "lz4", "lz4_raw", "snappy", "zstd"),
    "orc": ("none", "uncompressed", "lz4", "snappy", "zlib", "zstd"),
    "avro": ("uncompressed", "bzip2", "deflate", "snappy", "xz", "zstandard"),
}


@dataclass(frozen=True)
class FileTarget:
    """Where and how to write. ``overwrite`` false refuses a path that exists."""

    path: str
    format: str = "csv"
    delimiter: str = ","
    header: bool = True
    overwrite: bool = True
    append: bool = False
    codec: str | None = None
    partition_by: Sequence[str] = field(default_factory=tuple)
    options: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_options(cls, options: Mapping[str, Any], **more: Any) -> "FileTarget":
        """From job options: filePath, delimiter, overwrite; a missing or null one has its default."""
        names = {"filePath": "path", "delimiter": "delimiter", "overwrite": "overwrite"}
        given = {names[k]: v for k, v in options.items() if k in names and v is not None}
        return cls(**{"path": "", **given, **more})

    def check(self) -> None:
        if not self.path:
            raise ValueError("the target path is empty")
        if self.format not in CODECS:
            raise ValueError(f"unknown format {self.format!r}")
        if self.codec and self.codec.lower() not in CODECS[self.format]:
            raise ValueError(f"{self.format} has no codec {self.codec!r}")
        if self.format == "csv" and not self.delimiter:
            raise ValueError("the delimiter is empty")


def guard(spark: SparkSession, target: FileTarget) -> None:
    """Refuse a bad or taken target before any data is read."""
    target.check()
    if not target.overwrite and not target.append and path_exists(spark, target.path):
        raise FileExistsError(f"target exists: {target.path}")


def write_files(df: DataFrame, target: FileTarget) -> None:
    """Write part files from all tasks at once."""
    guard(df.sparkSession, target)
    _writer(together(df, target.partition_by), target).save(target.path)


def together(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of one directory meet in few tasks; adaptive execution splits large ones."""
    return df.hint("rebalance", *partition_by) if partition_by else df


def write_single_csv(df: DataFrame, target: FileTarget) -> None:
    """One CSV part file with one header, written by one task.

    It is meant for small reports that another program wants as one file. It does not scale;
    large results belong in part files, which every reader takes as one.
    """
    guard(df.sparkSession, target)
    _writer(df.repartition(1), target).save(target.path)


def _writer(df: DataFrame, target: FileTarget) -> DataFrameWriter:
    mode = "append" if target.append else "overwrite" if target.overwrite else "errorifexists"
    writer = df.write.format(target.format).mode(mode).options(**target.options)
    if target.format == "csv":
        writer = writer.option("header", target.header).option("sep", target.delimiter)
    if target.codec:
        writer = writer.option("compression", target.codec)
    if target.partition_by:
        writer = writer.partitionBy(*target.partition_by)
    return writer
