"""Messages that carry a row as a JSON array of strings, by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions.schema import ColumnSpec, from_text

ERRORS = "decode_errors"


def encode_positional(columns: Sequence[str | Column]) -> Column:
    """A row as a JSON array of strings; NULL stays JSON null."""
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.to_json(F.array(*[c.cast("string") for c in cells]))


def decode_positional(
    df: DataFrame, specs: Sequence[ColumnSpec], value: str = "value", keep: Sequence[str] = ()
) -> DataFrame:
    """The active columns of each message, typed, plus ``decode_errors``.

    A cell that does not fit its type becomes NULL and its column is named in
    ``decode_errors``; a value that is no JSON array is reported under its own name.
    ``decode_errors`` is comma-separated text, NULL on good rows.
    """
    active = [s for s in specs if s.active]
    cells = F.from_json(F.col(value).cast("string"), T.ArrayType(T.StringType()))
    raw = [F.get("__cells", F.lit(s.slot - 1)) for s in active]
    typed = df.select(*keep, cells.alias("__cells")).select(
        *keep,
        F.struct(
            F.col("__cells").isNull().alias("broken"),
            *[r.isNotNull().alias(f"g{i}") for i, r in enumerate(raw)],
            *[from_text(r, s).alias(f"v{i}") for i, (r, s) in enumerate(zip(raw, active))],
        ).alias("__row"),
    )
    # A filter on the result may not move below a generator, so each cell is typed once.
    wide = typed.select(*keep, F.inline(F.array("__row")))
    problems = [
        F.when(F.col(f"g{i}") & F.col(f"v{i}").isNull(), F.lit(s.name)) for i, s in enumerate(active)
    ]
    found = F.concat_ws(",", F.when(F.col("broken"), F.lit(value)), *problems)
    return wide.select(
        *keep,
        *[F.col(f"v{i}").alias(s.name) for i, s in enumerate(active)],
        F.when(found != "", found).alias(ERRORS),
    )


def split_rejects(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their errors)."""
    return (
        decoded.where(F.col(ERRORS).isNull()).drop(ERRORS),
        decoded.where(F.col(ERRORS).isNotNull()),
    )


def pad_ragged(
    df: DataFrame, specs: Sequence[ColumnSpec], cells: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Rows of text cells, filled up with ``''`` to the header length, then projected.

    Active columns come out as text, each from the cell at its ``order``.
    """
    width = max(s.slot for s in specs)
    short = F.greatest(F.lit(width) - F.size(cells), F.lit(0))
    padded = df.select(*keep, F.concat(F.col(cells), F.array_repeat(F.lit(""), short)).alias("__row"))
    return padded.select(
        *keep, *[F.get("__row", F.lit(s.slot - 1)).alias(s.name) for s in specs if s.active]
    )
