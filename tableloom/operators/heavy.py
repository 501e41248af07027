"""The most frequent values of a column with very many values, without counting all of them by shuffle.

First pass: every task keeps a summary of bounded size (Spark's frequent-items sketch, a Misra-Gries
variant), and the summaries are merged. An item that the summary does not name occurs at most as often
as its error bound. Second pass: the named candidates are counted exactly, in tasks that
look them up, so a task sends on one row per candidate at most. The list is complete if its last
count is above the bound, or if the candidates' counts add up to all rows; if not, a
larger summary is made, and at its limit all values are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACKED = 4096
MAX_TRACKED = 262_144  # at most so many candidates reach the driver and the broadcast
_SUMMED = (T.StringType, T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def error_bound(rows: int, tracked: int) -> int:
    """Occurrences that an item outside a summary of ``tracked`` items can have at most.

    The sketch's map has a power of two of places, of which it fills three quarters, and an error
    of 3.5 rows for every so many.
    """
    places = max(8, 1 << (-(-4 * tracked // 3) - 1).bit_length())
    return int(3.5 * rows / places)


def most_frequent(df: DataFrame, column: str, top: int, tracked: int = TRACKED) -> tuple[list[tuple], int]:
    """The ``top`` values with their exact counts, most frequent first and ties by value, and the number of rows.

    NULL is a value, before all others of its count.
    """
    values = df.select(F.col(f"`{column}`").alias("value"))
    kind = values.schema["value"].dataType
    order = (F.desc("n"), F.asc_nulls_first("value"))
    tracked = max(tracked, 2 * top)
    if isinstance(kind, _SUMMED) and getattr(kind, "collation", "UTF8_BINARY") in ("UTF8_BINARY", None):
        while tracked <= MAX_TRACKED:
            candidates, rows = _named(values, tracked, top)
            found = candidate_counts(values, candidates, kind).orderBy(*order).collect()
            listed = [(r["value"], r["n"]) for r in found[:top]]
            everything = sum(r["n"] for r in found) == rows
            if everything or (len(listed) == top and listed[-1][1] > error_bound(rows, tracked)):
                return listed, rows
            tracked *= 8
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    rows = values.count()
    return [(r["value"], r["n"]) for r in counts.orderBy(*order).limit(top).collect()], rows


def _named(values: DataFrame, tracked: int, top: int) -> tuple[list, int]:
    """Candidates of a merged summary, without those whose estimate rules them out, and the number of rows."""
    summary = F.call_function("approx_top_k", F.col("value"), F.lit(tracked), F.lit(tracked))
    row = values.agg(summary.alias("items"), F.count(F.lit(1)).alias("n")).first()
    items, rows = row["items"] or [], row["n"]
    bound = error_bound(rows, tracked)
    estimates = sorted((i["count"] for i in items), reverse=True)
    # Estimates are never too low, and too high by the bound at most.
    least = estimates[top - 1] - bound if len(estimates) >= top else 0
    return [i["item"] for i in items if i["count"] >= least], rows


def candidate_counts(values: DataFrame, candidates: list, kind: T.DataType) -> DataFrame:
    """(value, n) of the candidates, looked up in every task: their number is bounded."""
    named = values.sparkSession.createDataFrame([(c,) for c in candidates], T.StructType([T.StructField("named", kind)]))
    there = values.join(F.broadcast(named), F.col("value").eqNullSafe(F.col("named")), "left_semi")
    return there.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
