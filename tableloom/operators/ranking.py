"""Row numbers, top-k and fair order without putting a whole group into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableloom.functions.collation import collation_key
from tableloom.operators.skew import HOT_ROWS, has_hot_key, hashable
from tableloom.staging import stage

_ROW, _PART = "__row", "__part"
# Up to this row a slice is cut from the first rows of each task, without sorting the rest.
# The route is all that depends on it: both routes break ties alike.
SMALL_SLICE = 10_000
# Up to this k each task cuts its rows to the first k per key before the shuffle; beyond, a hot
# key would send too many. The sum is the same either way.
PRUNED_K = 100


def _as_column(order: str | Column) -> Column:
    return F.col(order) if isinstance(order, str) else order


def _content(df: DataFrame) -> Column:
    """What tells rows apart that tie on an order. Rows that tie on this too are copies."""
    return F.xxhash64(*hashable(df))


def _numbered(df: DataFrame, order: Sequence[Column], unique: bool) -> DataFrame:
    """``df`` range-sorted by ``order`` and written, with partition number and row number in it.

    Rows that tie on ``order`` are told apart by content and then by input partition, so
    even copies that make up a third of the table spread over many ranges.
    """
    ties: list[Column] = []
    if not unique:
        df = df.withColumns({"__tie1": _content(df), "__tie2": F.spark_partition_id()})
        ties = [F.col("__tie1"), F.col("__tie2")]
    ranged = df.repartitionByRange(*order, *ties).sortWithinPartitions(*order, *ties)
    # The id is (partition << 33) + row in partition; it is fixed once written.
    staged = stage(ranged.withColumn(_ROW, F.monotonically_increasing_id()).drop("__tie1", "__tie2"))
    return staged.withColumn(_PART, F.shiftright(_ROW, 33))


def with_position(
    df: DataFrame, order: Sequence[str | Column], name: str = "position", unique: bool = False
) -> DataFrame:
    """Add the 1-based place of each row in the total order.

    ``unique`` says that no two rows tie on ``order``.
    """
    rows = _numbered(df, [_as_column(o) for o in order], unique)
    # One line per written partition, whatever the number of rows.
    sizes = rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        _PART, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    in_part = F.col(_ROW) - F.shiftleft(_PART, 33)
    return rows.join(F.broadcast(offsets), _PART).select(
        *[f"`{c}`" for c in df.columns], (in_part + F.col("__before") + 1).alias(name)
    )


def with_group_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str = "position",
    first: Mapping[str, str] | None = None,
    unique: bool = False,
    group_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the 1-based place of each row within its key.

    ``first`` maps new columns to the columns they take from the first row of the group.
    A plain window does it while every group has at most ``group_rows`` rows. Beyond that
    the table is range-sorted by key and order, so a hot key covers many partitions, and
    the rows of earlier partitions are added on. Both break ties by the rows' content, so
    the result is the same, and the same again in a retried task.
    """
    first = dict(first or {})
    ordering = [_as_column(o) for o in order]
    if not has_hot_key(df, keys, group_rows + 1):
        window = W.partitionBy(*keys).orderBy(*ordering, *([] if unique else [_content(df)]))
        return df.select(
            *[f"`{c}`" for c in df.columns],
            F.row_number().over(window).cast("long").alias(name),
            *[F.first(source).over(window).alias(new) for new, source in first.items()],
        )
    rows = _numbered(df, [F.col(k) for k in keys] + ordering, unique)
    # A run is the part of one key in one partition.
    runs = rows.groupBy(_PART, *keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(_ROW).alias("__start"),
        *[F.min_by(source, _ROW).alias(f"__f_{new}") for new, source in first.items()],
    )
    along = W.partitionBy(*keys).orderBy(_PART)
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        F.col(_PART).alias("__rpart"),
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        "__start",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        *[F.first(f"__f_{new}").over(along).alias(new) for new in first],
    )
    on = F.col(_PART) == F.col("__rpart")
    for i, key in enumerate(keys):
        on = on & F.col(key).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(runs, on).select(
        *[f"`{c}`" for c in df.columns],
        (F.col(_ROW) - F.col("__start") + F.col("__before") + 1).alias(name),
        *first,
    )


def row_slice(
    df: DataFrame, order: Sequence[str | Column], start: int, end: int = 0, unique: bool = False
) -> DataFrame:
    """Rows ``start`` (0-based) up to, not including, ``end`` in the given order; 0 is no end."""
    if start < 0 or (end and end < start):
        raise ValueError("need 0 <= start <= end")
    if start == 0 and end == 0:
        return df
    if 0 < end <= SMALL_SLICE:
        ties = [] if unique else [_content(df)]
        return df.orderBy(*[_as_column(o) for o in order], *ties).offset(start).limit(end - start)
    placed = with_position(df, order, "__place", unique)
    wanted = F.col("__place") > start
    if end:
        wanted = wanted & (F.col("__place") <= end)
    return placed.where(wanted).drop("__place")


def top_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows in order, ties by the rows' content.

    Up to ``SMALL_SLICE`` rows each task keeps its own first ``n`` and one task merges them.
    More rows are cut by position and sorted in parallel, with the same result.
    """
    ordering = [_as_column(o) for o in order]
    if n <= SMALL_SLICE:
        return df.orderBy(*ordering, _content(df)).limit(n)
    placed = with_position(df, ordering, "__place").where(F.col("__place") <= n)
    return placed.orderBy("__place").drop("__place")


def top_k_sum(
    df: DataFrame, keys: Sequence[str], value: str, k: int, name: str = "total"
) -> DataFrame:
    """Sum of the ``k`` largest values per key.

    Up to ``PRUNED_K`` the cut is made in each task before the shuffle, so a hot key sends at
    most ``k`` rows per task; a larger ``k`` goes by position, which splits a hot key.
    """
    narrow = df.select(*keys, value)
    if k <= PRUNED_K:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).desc()))
        placed = narrow.withColumn("__place", place)
    else:
        placed = with_group_position(narrow, keys, [F.col(value).desc()], "__place")
    best = placed.where(F.col("__place") <= k)
    return best.groupBy(*keys).agg(F.sum(value).alias(name))


def custom_collation(df: DataFrame, column: str, order: str, then: Sequence[str] = ()) -> DataFrame:
    """Add ``position``: the order by a custom alphabet, then by the text itself and ``then``."""
    keyed = df.withColumn("__key", collation_key(F.col(column), order))
    return with_position(keyed, ["__key", column, *then]).drop("__key")


def fair_interleave(
    df: DataFrame, tenant: str, arrival: Sequence[str], unique: bool = False, group_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``round`` and ``position``: one row per tenant and round, tenants by first arrival."""
    firsts = {f"__first_{c}": c for c in arrival}
    rounds = with_group_position(
        df, [tenant], arrival, "round", firsts, unique=unique, group_rows=group_rows
    )
    return with_position(rounds, ["round", *firsts, tenant], unique=True).drop(*firsts)
