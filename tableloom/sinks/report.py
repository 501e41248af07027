"""Counters taken while a result is written, in the same job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tableloom.functions.schema import export_schema


@dataclass(frozen=True)
class RunReport:
    """``errors`` counts rejected messages and lines of the sources too; ``read`` includes them."""

    read: int
    written: int
    ignored: int
    errors: int
    schema: dict[str, dict[str, Any]]


def write_with_report(
    df: DataFrame,
    write: Callable[[DataFrame], None],
    ignore: Column | None = None,
    error: Column | None = None,
    rejected: int = 0,
) -> RunReport:
    """Write the rows that are neither ignored nor in error, and count all three.

    A row that is both is an error. The write sees each row once; no second job counts.
    ``rejected`` is what the sources turned away before.
    """
    bad = F.coalesce(error, F.lit(False)) if error is not None else F.lit(False)
    skip = F.coalesce(ignore, F.lit(False)) if ignore is not None else F.lit(False)
    observation = Observation()
    marked = df.withColumns({"__bad": bad, "__skip": skip & ~bad})
    counted = marked.observe(
        observation,
        F.count(F.lit(1)).alias("rows"),
        F.count_if("__bad").alias("errors"),
        F.count_if("__skip").alias("ignored"),
    )
    write(counted.where(~F.col("__bad") & ~F.col("__skip")).drop("__bad", "__skip"))
    seen = observation.get
    return RunReport(
        read=seen["rows"] + rejected,
        written=seen["rows"] - seen["errors"] - seen["ignored"],
        ignored=seen["ignored"],
        errors=seen["errors"] + rejected,
        schema=export_schema(df),
    )
