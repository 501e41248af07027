"""Equi-joins by configuration, with unique column names in the result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.functions.names import unique_names
from tableloom.operators.skew import HOT_ROWS, hot_keys, spread
from tableloom.staging import stage

# Up to so many hot keys are broadcast; more are joined by key. The result is the same.
FEW_HOT = 10_000
# Sides whose hot keys adaptive execution splits by itself, by join type.
SPLIT_BY_SPARK = {"inner": ("left", "right"), "left": ("left",), "right": ("right",), "left_semi": ("left",), "left_anti": ("left",)}
# Accepted join types and what Spark calls them.
JOIN_TYPES = {
    "inner": "inner",
    "left": "left",
    "leftouter": "left",
    "left_outer": "left",
    "right": "right",
    "rightouter": "right",
    "right_outer": "right",
    "full": "full",
    "outer": "full",
    "fullouter": "full",
    "full_outer": "full",
    "semi": "left_semi",
    "leftsemi": "left_semi",
    "left_semi": "left_semi",
    "anti": "left_anti",
    "leftanti": "left_anti",
    "left_anti": "left_anti",
}


def _checked(left, right, left_keys, right_keys, how) -> tuple[list[str], list[str], str]:
    left_keys = [left_keys] if isinstance(left_keys, str) else list(left_keys)
    right_keys = [right_keys] if isinstance(right_keys, str) else list(right_keys)
    if not left_keys or len(left_keys) != len(right_keys):
        raise ValueError("the two key lists must have the same length, at least one")
    for side, df, keys in (("left", left, left_keys), ("right", right, right_keys)):
        names = [c.lower() for c in df.columns]
        for key in keys:
            if names.count(key.lower()) != 1:
                raise ValueError(f"{side} key {key!r} must name exactly one column")
    if how.lower() not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}")
    return left_keys, right_keys, JOIN_TYPES[how.lower()]


def _side(df: DataFrame, mark: str, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with names no other frame has, and its keys under those names."""
    lower = [c.lower() for c in df.columns]
    renamed = df.toDF(*[f"__{mark}{i}" for i in range(len(lower))])
    return renamed, [f"__{mark}{lower.index(k.lower())}" for k in keys]


def _same(left_keys: Sequence[str], right_keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for i, (l, r) in enumerate(zip(left_keys, right_keys, strict=True)):
        condition = (F.col(l) == F.col(r)) if i == 0 else condition & (F.col(l) == F.col(r))
    return condition


def equi_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: str | Sequence[str],
    right_keys: str | Sequence[str],
    how: str = "inner",
    repair: str = "suffix",
    skew_safe: bool | Sequence[str] = True,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join two frames on equal keys and make the column names unique.

    Adaptive execution splits a hot key on the sides of ``SPLIT_BY_SPARK``. On the other
    sides, or on all if that rule is off or ``hot_rows`` is given, hot keys are looked for
    first (see ``hot_keys``). Without a key of ``hot_rows`` rows (a million) or more the join is
    Spark's own. Otherwise a hot key gets one salt per ``hot_rows`` rows: its rows take
    one salt each, and the rows of the other side that meet it are repeated for all salts.
    Semi and anti joins meet distinct keys only.

    ``skew_safe`` may name the sides to count, ``("left",)`` when the right keys are unique,
    or be False when neither side can have a hot key.
    """
    left_keys, right_keys, how = _checked(left, right, left_keys, right_keys, how)
    sides = ("left", "right") if skew_safe is True else tuple(skew_safe or ())
    if how in ("left_semi", "left_anti") and sides:
        right, sides = right.select(*right_keys).distinct(), ("left",)
    if hot_rows is None and _splits(left):
        sides = tuple(side for side in sides if side not in SPLIT_BY_SPARK.get(how, ()))
    hot_rows = hot_rows or HOT_ROWS
    l, lk = _side(left, "l", left_keys)
    r, rk = _side(right, "r", right_keys)
    if sides and not (left.isStreaming or right.isStreaming):
        marks = [f"__h{i}" for i in range(len(lk))]
        hot = _hot_table({"left": (l, lk), "right": (r, rk)}, sides, marks, hot_rows)
        if hot is not None:
            return _named(_salted(l, lk, r, rk, how, hot, marks), left, right, how, repair)
    return _named(l.join(r, _same(lk, rk), how), left, right, how, repair)


def _splits(df: DataFrame) -> bool:
    conf = df.sparkSession.conf
    return all(conf.get(f"spark.sql.adaptive.{n}", "true") == "true" for n in ("enabled", "skewJoin.enabled"))


def _named(joined: DataFrame, left: DataFrame, right: DataFrame, how: str, repair: str) -> DataFrame:
    if how in ("left_semi", "left_anti"):
        return joined.toDF(*left.columns)
    return joined.toDF(*unique_names(left.columns + right.columns, repair))


def _salted(l, lk, r, rk, how, hot, marks) -> DataFrame:
    if hot.count() <= FEW_HOT:
        hot = F.broadcast(hot)
    l2 = _placed(l, lk, hot, marks, "left", "right")
    r2 = _placed(r, rk, hot, marks, "right", "left")
    on = _same(lk, rk)
    for side in ("left", "right"):
        on = on & (F.col(f"__left_{side}") == F.col(f"__right_{side}"))
    joined = l2.join(r2, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*l.columns)
    # A copy of a row may find no partner under its salt. Its key is known to have one, so
    # such a copy is no result; rows whose key is not hot on the other side have one copy.
    if how in ("left", "full"):
        joined = joined.where(~(F.col("__right_sure").isNull() & F.col("__left_sure")))
    if how in ("right", "full"):
        joined = joined.where(~(F.col("__left_sure").isNull() & F.col("__right_sure")))
    return joined.select(*l.columns, *r.columns)


def _hot_table(frames, sides, marks, hot_rows) -> DataFrame | None:
    """The hot keys, if any, written once, so that both sides of the join see the same ones.

    Per key: how many salts its rows take on each side, 0 where it is not hot. The NULL key
    is in here too: it matches nothing, but it has to be noticed.
    """
    found = None
    for side in sides:
        df, keys = frames[side]
        hot = hot_keys(df, keys, hot_rows)
        if hot.isEmpty():
            continue
        salts = F.ceil(F.col("rows") / hot_rows).cast("long")
        hot = hot.select(
            *[F.col(k).alias(m) for k, m in zip(keys, marks)],
            *[(salts if side == s else F.lit(0).cast("long")).alias(f"__{s}_n") for s in frames],
        )
        found = hot if found is None else found.unionByName(hot)
    if found is None:
        return None
    if len(sides) > 1:
        found = found.groupBy(*marks).agg(*[F.max(f"__{s}_n").alias(f"__{s}_n") for s in frames])
    return stage(found, "hot")


def _placed(df: DataFrame, keys, hot: DataFrame, marks, own: str, other: str) -> DataFrame:
    """``df`` with its salt, repeated for every salt of the other side."""
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    marked = df.withColumn("__any", spread(df)).join(hot, _same(keys, marks), "left")
    own_salts, copies = (F.greatest(F.coalesce(f"__{s}_n", F.lit(0)), F.lit(1)) for s in (own, other))
    # Rows without a key match nothing, so they may lie anywhere.
    salt = F.when(no_key, F.col("__any")).otherwise(F.pmod("__any", own_salts))
    return marked.select(
        *df.columns,
        salt.alias(f"__{own}_{own}"),
        (F.coalesce(f"__{other}_n", F.lit(0)) > 0).alias(f"__{own}_sure"),
        F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias(f"__{own}_{other}"),
    )


def dedupe_columns(df: DataFrame, style: str = "suffix", prefix: str = "bbl_") -> DataFrame:
    """Rename repeated columns so that the frame can be written."""
    return df.toDF(*unique_names(df.columns, style, prefix))


@dataclass(frozen=True)
class MappedColumn:
    """One output column: taken from a left column, a right column, or either."""

    output: str
    left: str | None = None
    right: str | None = None


def mapped_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: str | Sequence[str],
    right_keys: str | Sequence[str],
    columns: Sequence[MappedColumn],
    how: str = "left",
) -> DataFrame:
    """Outer join with a listed output: columns in order, each from the named source column.

    ``how='left'`` takes a column mapped on both sides from the left; ``how='full'`` also
    keeps right rows without a partner and fills such columns from the right.
    """
    if how not in ("left", "full"):
        raise ValueError("a mapped join is 'left' or 'full'")
    joined = equi_join(
        left.toDF(*[f"left_{c}" for c in left.columns]),
        right.toDF(*[f"right_{c}" for c in right.columns]),
        [f"left_{k}" for k in ([left_keys] if isinstance(left_keys, str) else left_keys)],
        [f"right_{k}" for k in ([right_keys] if isinstance(right_keys, str) else right_keys)],
        how,
    )
    picked = []
    for column in columns:
        sources = [f"left_{column.left}"] if column.left else []
        if column.right and (how == "full" or not column.left):
            sources.append(f"right_{column.right}")
        if not sources:
            raise ValueError(f"output column {column.output!r} has no source")
        picked.append(F.coalesce(*[F.col(f"`{s}`") for s in sources]).alias(column.output))
    return joined.select(*picked)


def broadcast_join(
    left: DataFrame,
    small: DataFrame,
    left_keys: str | Sequence[str],
    right_keys: str | Sequence[str],
    how: str = "inner",
    max_rows: int = 1_000_000,
    max_bytes: int = 64 << 20,
) -> DataFrame:
    """Equi-join that broadcasts ``small`` when its measured size is below both limits.

    The limits decide on the route only: a larger side takes the normal join, with the same
    result.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only the right side of these joins can be broadcast")
    if is_small(small, max_rows, max_bytes):
        return equi_join(left, F.broadcast(small), left_keys, right_keys, how, skew_safe=False)
    return equi_join(left, small, left_keys, right_keys, how)


def is_small(df: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether ``df`` stays within the limits. Widths are only measured when the rows are few."""
    if df.count() > max_rows:
        return False
    width = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    return (df.agg(F.sum(width)).first()[0] or 0) <= max_bytes
