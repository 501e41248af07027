"""Nested records as one map from path to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTRIES = "array<struct<key:string,value:string>>"


def flatten_record(df: DataFrame, columns: list[str] | None = None, separator: str = "|") -> Column:
    """A map ``path -> text`` over ``columns``; NULL leaves are left out.

    Struct fields and map keys join the path. Arrays have no path and are an error.
    Two leaves with one path fail the job.
    """
    fields = [df.schema[c] for c in (columns or df.columns)]
    parts = [_entries(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name), separator) for f in fields]
    return F.map_from_entries(F.filter(F.concat(*parts), lambda e: e["value"].isNotNull()))


def _entries(value: Column, data_type: T.DataType, path: Column, separator: str) -> Column:
    if isinstance(data_type, T.ArrayType):
        raise TypeError("arrays cannot be flattened")
    if isinstance(data_type, T.StructType):
        inner = [
            _entries(value[f.name], f.dataType, F.concat(path, F.lit(separator + f.name)), separator)
            for f in data_type.fields
        ]
        return F.concat(*inner) if inner else F.array().cast(_ENTRIES)
    if isinstance(data_type, T.MapType):
        per_key = F.transform(
            F.map_entries(value),
            lambda e: _entries(
                e["value"],
                data_type.valueType,
                F.concat(path, F.lit(separator), e["key"].cast("string")),
                separator,
            ),
        )
        return F.coalesce(F.flatten(per_key), F.array().cast(_ENTRIES))
    return F.array(F.struct(path.alias("key"), value.cast("string").alias("value")))
