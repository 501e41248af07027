"""Projection, filters and cell repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions.names import normal_names


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename by position; the list must cover every column."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def normalise_names(df: DataFrame, upper: bool = False) -> DataFrame:
    """Spaces to underscores in every name, in one projection."""
    return df.toDF(*normal_names(df.columns, upper))


def filter_eq(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Rows where ``column`` equals ``value``; the literal takes the type of the column."""
    field = df.schema[column]
    return df.where(F.col(f"`{column}`") == F.lit(value).cast(field.dataType))


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns; text that does not fit becomes NULL."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in types.items()})


def blank_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Blank text cells become NULL; other types are left alone."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chosen = text if columns is None else [c for c in columns if c in text]
    return df.withColumns(
        {c: F.when(F.trim(f"`{c}`") != "", F.col(f"`{c}`")) for c in chosen}
    ) if chosen else df


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL, in any column or in the named ones."""
    return df.dropna(subset=list(columns) if columns else None)


def encode_key_json(
    df: DataFrame, key: str, columns: Sequence[str] | None = None, blanks_to_null: bool = True
) -> DataFrame:
    """(key, value): the key as text and the row as a JSON object without NULL fields."""
    body = df.select(*[f"`{c}`" for c in (columns or df.columns)])
    if key not in df.columns:
        raise ValueError(f"key column {key!r} is not in the data")
    named = body.columns
    keyed = df.select(F.col(f"`{key}`").cast("string").alias("__key"), *[f"`{c}`" for c in named])
    if blanks_to_null:
        keyed = blank_to_null(keyed, named)
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in named]))
    return keyed.select(F.col("__key").alias("key"), value.alias("value"))


def column_sizes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, max_length): the longest text form per column, in one pass."""
    chosen = list(columns or df.columns)
    widths = df.agg(
        *[
            F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)).alias(f"__{i}")
            for i, c in enumerate(chosen)
        ]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"__{i}").cast("long").alias("max_length"))
            for i, c in enumerate(chosen)
        ]
    )
    return widths.select(F.inline(pairs))


@dataclass(frozen=True)
class DerivedColumn:
    """A new column. ``inputs`` are the columns the expression reads."""

    name: str
    expression: str
    inputs: tuple[str, ...]


@dataclass(frozen=True)
class DerivedReport:
    column_name: str
    expression: str
    applied: int
    failed: int
    missing: tuple[str, ...]


def derive(df: DataFrame, columns: Sequence[DerivedColumn]) -> tuple[DataFrame, "DerivedCounts"]:
    """Add the columns whose inputs exist and count, during the next action, how they went.

    An expression uses the ``try_`` functions, so a row it cannot handle gives NULL. Such a
    row counts as failed when none of the inputs was NULL. A column with missing inputs is
    added as NULL text and failed on every row.
    """
    missing = {c.name: tuple(i for i in c.inputs if i not in df.columns) for c in columns}
    counts: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, column in enumerate(columns):
        if missing[column.name]:
            df = df.withColumn(column.name, F.lit(None).cast("string"))
            continue
        df = df.withColumn(column.name, F.expr(column.expression))
        given = F.lit(True)
        for name in column.inputs:
            given = given & F.col(f"`{name}`").isNotNull()
        failed = F.col(f"`{column.name}`").isNull() & given
        counts.append(F.count(F.when(failed, 1)).alias(f"failed_{i}"))
    observation = Observation()
    return df.observe(observation, *counts), DerivedCounts(observation, tuple(columns), missing)


@dataclass(frozen=True)
class DerivedCounts:
    observation: Observation
    columns: tuple[DerivedColumn, ...]
    missing: dict[str, tuple[str, ...]]

    def report(self) -> list[DerivedReport]:
        """One line per derived column; waits for the first action on the frame."""
        seen = self.observation.get
        lines = []
        for i, c in enumerate(self.columns):
            failed = seen["rows"] if self.missing[c.name] else seen[f"failed_{i}"]
            lines.append(
                DerivedReport(c.name, c.expression, seen["rows"] - failed, failed, self.missing[c.name])
            )
        return lines
