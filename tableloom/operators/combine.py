"""Pairs and combinations of values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.staging import stage

# So many items are bits of a signed 64-bit number; it decides on the route only.
MASK_ITEMS = 62
BUCKETS = 1 << 20
# Rows, or pairs, for one task; it decides on the number of tasks and the route only.
TASK_ROWS = 1 << 19


def _values(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()


def pairs_with_sum(df: DataFrame, column: str, total) -> DataFrame:
    """(low, high): different values that add up to ``total``, each pair once.

    Every value looks up its one partner, so work grows with the values, not their square.
    """
    low, high = _values(df, column, "low"), _values(df, column, "high")
    pairs = low.join(high, F.lit(total) - F.col("low") == F.col("high"))
    return pairs.where(F.col("low") < F.col("high"))


def pairs_with_difference(df: DataFrame, column: str, difference) -> DataFrame:
    """(low, high): values with ``high - low = difference``."""
    if difference <= 0:
        raise ValueError("the difference of two different values is positive")
    low, high = _values(df, column, "low"), _values(df, column, "high")
    return low.join(high, F.col("low") + F.lit(difference) == F.col("high"))


def item_combinations(
    df: DataFrame,
    group: str,
    item: str,
    size: int,
    catalogue: DataFrame | None = None,
    min_support: int = 1,
    mask_items: int = MASK_ITEMS,
) -> DataFrame:
    """(items, support): ``size``-item combinations that at least ``min_support`` groups hold.

    The items are those of ``catalogue``, a frame of one column, or else those in the data;
    NULL is no item. Up to 62 items a group, however large, folds into one bit mask on the
    map side, equal masks are counted together, and only distinct masks are spelled out.
    With more items, combinations grow by one item at a time: what is held by fewer than
    ``min_support`` groups can be part of no result. Items are dropped before pairs are built,
    pairs by hashed counts before they are sent on, and longer combinations unless all their
    parts are frequent; all of that is exact. Both routes give the same result.
    """
    if size < 1:
        raise ValueError("a combination has at least one item")
    if min_support < 1:
        raise ValueError("support is at least one")
    known = (df.select(item) if catalogue is None else catalogue).toDF("item")
    known = known.where(F.col("item").isNotNull()).distinct()
    items = [row[0] for row in known.orderBy("item").limit(min(mask_items, MASK_ITEMS) + 1).collect()]
    kind = df.schema[item].dataType
    if not items:
        return df.sparkSession.createDataFrame([], f"items array<{kind.simpleString()}>, support long")
    if len(items) > min(mask_items, MASK_ITEMS):
        return _grown(df, group, item, size, known if catalogue is not None else None, min_support)
    return _by_masks(df, group, item, size, items, kind).where(F.col("support") >= min_support)


def _grown(df: DataFrame, group: str, item: str, size: int, known: DataFrame | None, least: int) -> DataFrame:
    # A structure is a key even where the group is NULL.
    rows = df.select(F.struct(group).alias("g"), F.col(item).alias("i")).where("i IS NOT NULL")
    tasks = _tasks(rows.count())
    # Rows come together before they are told apart: few are equal, so a task of the input would hold nearly all it reads.
    baskets = rows.repartition(tasks, "g", "i").distinct()
    if known is not None:
        baskets = baskets.join(known.select(F.col("item").alias("i")), "i", "left_semi")
    baskets = stage(baskets, "baskets")
    counts = baskets.repartition(tasks, "i").groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    items = counts.agg(F.count(F.lit(1)).alias("all"), F.min("n").alias("rarest"), F.max("n").alias("most")).first()
    # What no more groups hold than a task takes can be dealt by key; more is left to adaptive execution.
    common = (items["most"] or 0) > TASK_ROWS

    def frequent(combos: DataFrame, keys: list[str], total: float, length: int) -> DataFrame:
        if not common and 4 * math.comb(items["all"], length) > total:
            combos = combos.select(*keys).repartition(_tasks(total), *keys)
        return combos.groupBy(*keys).agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)

    if size == 1:
        return frequent(baskets.select("g", F.array("i").alias("items")), ["items"], baskets.count(), 1)
    singles = baskets
    if (items["rarest"] or least) < least:
        singles = stage(_meet(baskets, counts.where(F.col("n") >= least), "i", "left_semi", tasks, common), "singles")
    n = F.col("n").cast("double")
    sizes = singles.repartition(tasks, "g").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    held = sizes.agg(F.sum(n * (n - 1) / 2).alias("pairs"), F.max(n * (n - 1) / 2).alias("most")).first()
    total, large = held["pairs"] or 0.0, (held["most"] or 0.0) > TASK_ROWS
    pairs = _pairs(singles, least, total, large)
    if size == 2:
        return frequent(pairs, ["a", "b"], total, 2).select(F.array("a", "b").alias("items"), "support")
    combos = stage(pairs.select("g", F.array("a", "b").alias("items")), "combinations")
    for length in range(3, size + 1):
        total = combos.count()
        tasks = _tasks(total)
        counted = stage(frequent(combos, ["items"], total, length - 1), "support")
        # Rising order spells each combination once; a group's rows meet on its key.
        held = _meet(combos, counted, "items", "left_semi", tasks, common)
        grown = _meet(held, singles, "g", "inner", tasks, large).where(F.col("i") > F.element_at("items", -1))
        grown = grown.select("g", F.concat("items", F.array("i")).alias("items"))
        combos = stage(_all_parts(grown, counted, length, tasks, common) if least > 1 else grown, "combinations")
    return frequent(combos, ["items"], combos.count(), size)


def _tasks(rows: float) -> int:
    return max(1, math.ceil(rows / TASK_ROWS))


def _meet(left: DataFrame, right: DataFrame, key: str, how: str, tasks: int, crowded: bool) -> DataFrame:
    """A join of as many tasks as the rows need, which adaptive execution does not merge by their compressed size.

    Where one key is ``crowded`` the join is Spark's own, as that can split a key.
    """
    if crowded:
        return left.join(right, key, how)
    return left.repartition(tasks, key).join(right.repartition(tasks, key), key, how)


def _pairs(singles: DataFrame, least: int, total: float, large: bool) -> DataFrame:
    """(g, a, b): pairs of items, without those that a table of hashed counts rules out.

    Pairs are counted into ``BUCKETS`` buckets, so a task sends on no more than that however many
    pairs it meets. A pair has no more groups than its bucket, so below ``least`` it is out.
    The buckets that are left, at most ``BUCKETS`` numbers, are looked up in every task. The table is
    left out where it cannot help: with hardly more pairs than buckets, or with so many that every
    bucket fills; the number of pairs follows from the sizes of the groups.
    """
    left, right = singles.select("g", F.col("i").alias("a")), singles.select("g", F.col("i").alias("b"))
    pairs = _meet(left, right, "g", "inner", _tasks(total), large).where("a < b")
    if least > 1 and 4 < total / BUCKETS < 4 * least:
        pairs = pairs.withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS)).cast("int"))
        full = pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        pairs = pairs.join(F.broadcast(full.select("bucket")), "bucket", "left_semi")
    return pairs.select("g", "a", "b")


def _all_parts(grown: DataFrame, counted: DataFrame, length: int, tasks: int, common: bool) -> DataFrame:
    """Those of ``grown`` all of whose parts of one item less are in ``counted``; the part without the last one is."""
    parts = counted.select(F.col("items").alias("part"))
    for left_out in range(length - 1):
        rest = F.concat(F.slice("items", 1, left_out), F.slice("items", left_out + 2, length))
        grown = _meet(grown.withColumn("part", rest), parts, "part", "left_semi", tasks, common).drop("part")
    return grown


def _by_masks(df: DataFrame, group: str, item: str, size: int, items: list, kind) -> DataFrame:
    labels = F.array(*[F.lit(v).cast(kind) for v in items])
    place = F.array_position(labels, F.col(item)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place - 1)
    masks = (
        df.where(place > 0)
        .groupBy(group)
        .agg(F.bit_or(bit).alias("mask"))
        .groupBy("mask")
        .agg(F.count(F.lit(1)).alias("groups"))
    )
    places = F.filter(
        F.sequence(F.lit(0), F.lit(len(items) - 1)), lambda i: F.getbit("mask", i) == 1
    )
    # A combination is a mask too; taking places in rising order spells each one once.
    chosen = masks.select("groups", places.alias("places"), F.lit(0).cast("long").alias("combo"))
    for _ in range(size):
        chosen = chosen.select("groups", "combo", "places", F.posexplode("places")).select(
            "groups",
            F.slice("places", F.col("pos") + 2, F.size("places")).alias("places"),
            F.col("combo").bitwiseOR(
                F.call_function("shiftleft", F.lit(1).cast("long"), F.col("col"))
            ).alias("combo"),
        )
    counted = chosen.groupBy("combo").agg(F.sum("groups").alias("support"))
    numbered = F.filter(F.sequence(F.lit(1), F.lit(len(items))), lambda i: F.getbit("combo", i - 1) == 1)
    return counted.select(F.transform(numbered, lambda i: F.element_at(labels, i)).alias("items"), "support")
