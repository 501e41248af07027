"""Frequency tables, summaries and rows collected by key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.operators.ranking import with_group_position
from tableloom.operators.skew import HOT_ROWS


def frequency(df: DataFrame, columns: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.col(name).desc(), *columns)


def month_segment_counts(df: DataFrame, day: str, segment: str, month: str) -> DataFrame:
    """Rows per segment in one ``yyyyMM`` month.

    ``day`` is a date, a timestamp, or a ``yyyyMM`` number or text as partitions have it.
    The filter stays on the raw column, so it reaches partitions and Parquet statistics.
    """
    start = dt.datetime.strptime(month, "%Y%m")
    end = (start + dt.timedelta(days=32)).replace(day=1)
    kind = df.schema[day].dataType
    if isinstance(kind, (T.IntegralType, T.StringType)):
        inside = F.col(day) == F.lit(int(month) if isinstance(kind, T.IntegralType) else month).cast(kind)
    else:
        inside = (F.col(day) >= F.lit(start.isoformat()).cast(kind)) & (
            F.col(day) < F.lit(end.isoformat()).cast(kind)
        )
    return (
        df.where(inside)
        .groupBy(segment)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(month).alias("month_period"), segment, "n")
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, stddev, min and max, from a single pass."""
    measures = []
    for i, name in enumerate(columns):
        value = F.col(f"`{name}`")
        measures += [
            F.count(value).alias(f"count_{i}"),
            F.avg(value).alias(f"mean_{i}"),
            F.stddev_samp(value).alias(f"stddev_{i}"),
            F.min(value).cast("double").alias(f"min_{i}"),
            F.max(value).cast("double").alias(f"max_{i}"),
        ]
    parts = ("count", "mean", "stddev", "min", "max")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"), *[F.col(f"{p}_{i}").alias(p) for p in parts]
            )
            for i, name in enumerate(columns)
        ]
    )
    return df.agg(*measures).select(F.inline(rows))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in the given order; each task sends at most one row per key."""
    others = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*[f"`{c}`" for c in others]), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, "__last.*").select(*df.columns)


def sum_scale(df: DataFrame, column: str, factor: int | float, name: str = "result") -> DataFrame:
    """The sum of a column times a parameter."""
    return df.agg((F.sum(column) * F.lit(factor)).alias(name))


def in_batches(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    size: int,
    item: Column,
    unique: bool = False,
    group_rows: int = HOT_ROWS,
) -> DataFrame:
    """(key, batch_no, n, items): each key's rows in order, cut into lists of at most ``size``.

    Keys never share a batch, and a key with more rows has more batches, so no list grows
    with the data.
    """
    if size < 1:
        raise ValueError("a batch holds at least one row")
    placed = with_group_position(df, [key], order, "__place", unique=unique, group_rows=group_rows)
    numbered = placed.select(
        key,
        F.floor((F.col("__place") - 1) / size).cast("long").alias("batch_no"),
        F.struct("__place", item.alias("item")).alias("__item"),
    )
    listed = numbered.groupBy(key, "batch_no").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("__item")).alias("__items")
    )
    return listed.select(key, "batch_no", "n", F.col("__items.item").alias("items"))


def collect_by_key(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    order: Sequence[str],
    size: int = 1_000,
    unique: bool = False,
    group_rows: int = HOT_ROWS,
) -> DataFrame:
    """All rows of each key as lists of text cells, ``size`` rows per list at most."""
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in columns])
    return in_batches(df, key, order, size, cells, unique, group_rows)
