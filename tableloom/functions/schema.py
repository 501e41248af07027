"""Schema descriptors: ``{column: {type, order, active[, size, date_format]}}``.

``order`` decides the column order, then the order of declaration. Columns with
``active`` false are left out; a missing ``active`` means true. All columns are
nullable, and an unknown type is read as a string.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type names descriptors use.
TYPE_NAMES: dict[str, T.DataType] = {
    "IntegerType()": T.IntegerType(),
    "FloatType()": T.FloatType(),
    "DoubleType()": T.DoubleType(),
    "StringType()": T.StringType(),
    "LongType()": T.LongType(),
    "ShortType()": T.ShortType(),
    "ByteType()": T.ByteType(),
    "BooleanType()": T.BooleanType(),
    "DateType()": T.DateType(),
    "TimestampType()": T.TimestampType(),
    "TimestampNTZType()": T.TimestampNTZType(),
    "BinaryType()": T.BinaryType(),
}
_DECIMAL = re.compile(r"DecimalType\((\d+),\s*(\d+)\)")


@dataclass(frozen=True)
class ColumnSpec:
    """One column of a descriptor; ``slot`` is its 1-based place in a positional message."""

    name: str
    type: T.DataType
    slot: int
    active: bool = True
    date_format: str | None = None


def type_from_name(name: str) -> T.DataType:
    decimal = _DECIMAL.fullmatch(name)
    if decimal:
        return T.DecimalType(int(decimal[1]), int(decimal[2]))
    return TYPE_NAMES.get(name, T.StringType())


def name_from_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.DecimalType):
        return f"DecimalType({data_type.precision},{data_type.scale})"
    name = f"{type(data_type).__name__}()"
    return name if name in TYPE_NAMES else data_type.simpleString()


def import_schema(descriptor: str | Mapping[str, Mapping[str, Any]]) -> list[ColumnSpec]:
    """All columns of a descriptor, inactive ones too, in message order."""
    if isinstance(descriptor, str):
        descriptor = json.loads(descriptor)
    columns = [
        ColumnSpec(
            name=name,
            type=type_from_name(detail.get("type", "StringType()")),
            slot=int(detail.get("order", place)),
            active=bool(detail.get("active", True)),
            date_format=detail.get("date_format") or None,
        )
        for place, (name, detail) in enumerate(descriptor.items(), start=1)
    ]
    return sorted(columns, key=lambda c: c.slot)


def struct_type(columns: list[ColumnSpec]) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.type, True) for c in columns if c.active])


def export_schema(df: DataFrame) -> dict[str, dict[str, Any]]:
    """The descriptor of ``df``: every column, upper-case names, 1-based order."""
    return {
        field.name.upper(): {
            "type": name_from_type(field.dataType),
            "order": place,
            "active": True,
        }
        for place, field in enumerate(df.schema.fields, start=1)
    }


def from_text(text: Column, spec: ColumnSpec) -> Column:
    """A text cell as the declared type; NULL where it does not fit.

    Whole numbers go through double and are cut towards zero, so ``12.9`` is 12.
    """
    if isinstance(spec.type, T.StringType):
        return text
    if isinstance(spec.type, (T.IntegerType, T.ShortType, T.ByteType)):
        return text.try_cast("double").try_cast(spec.type)
    if isinstance(spec.type, T.LongType):
        # Above 2^53 a double is too coarse, so plain whole numbers are cast directly.
        return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))
    if spec.date_format and isinstance(spec.type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.try_to_timestamp(text, F.lit(spec.date_format)).cast(spec.type)
    return text.try_cast(spec.type)


def apply_schema(df: DataFrame, descriptor: str | Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Type a frame of text columns by name: active columns only, in descriptor order."""
    active = [c for c in import_schema(descriptor) if c.active]
    known = {name.lower() for name in df.columns}
    missing = [c.name for c in active if c.name.lower() not in known]
    if missing:
        raise ValueError(f"columns not in the data: {missing}")
    return df.select(*[from_text(df[f"`{c.name}`"].cast("string"), c).alias(c.name) for c in active])
