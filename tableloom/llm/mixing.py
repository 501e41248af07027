"""Mixing sources to target weights by capped water-filling.

A budget of words is shared among sources by weight. A source whose share exceeds its cap
(``max_epochs`` times its size) is clamped there and the excess is shared again by weight, until
none is above. Each pass is one aggregate over the table of sources; the driver sees two sums.

A source's rate (target over size) gives every document its whole repetitions. For the fraction
documents are put into a seeded order and take one more repetition until the words needed are
reached. The order is cut into 4 096 ranges per source: sums per range are added up first, so a
source with a third of all rows is worked on by many tasks.

Rows that agree in source, id and text are one entry with a number of copies. They follow each other
in the order, and how many of them take one more repetition is computed, so they are never spelled
out before the result. At most one entry of a source is taken in part.

Defined results: NULL text has size 0; a NULL source is a source, the last in order; of an entry
taken in part, the rows first by content take one more; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableloom.llm.text import WORD, free_names
from tableloom.operators.ranking import with_group_position, with_position
from tableloom.staging import stage

SEED = 20_26
MAX_EPOCHS = 2
BUDGET = 1.5  # of all words
WEIGHTS = (3, 1, 2)  # by place in the order of sources, repeating
RANGES = 4096


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: shares of ``budget`` below the caps.

    ``sources`` must be staged: it is read once per pass.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    share = lambda level: F.col("weight") * F.lit(level)
    total = sources.agg(F.sum("weight")).first()[0] or 1
    level, clamped = budget / total, -1
    while True:
        above = share(level) > cap
        full, weight, n = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
            F.count(F.when(above, F.lit(1))),
        ).first()
        if n == clamped or not weight:
            break
        level, clamped = (budget - full) / weight, n
    return sources.withColumn("target", F.least(share(level), cap))


def mixing_plan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    budget: float = BUDGET,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row per entry: key, source, order hash, size, copies, source_size, target, repetitions, extra.

    Each of the ``copies`` is taken ``repetitions`` times, ``extra`` of them once more.
    """
    sizes = stage(
        docs.select(
            F.col(f"`{key}`").alias("key"),
            F.col(f"`{source}`").alias("source"),
            word_count(F.col(f"`{text}`")).alias("size"),
            row_hash(key, text, seed).alias("h"),
        ),
        "sizes",
    )
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("position") - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = stage(with_position(totals, order, unique=True).withColumn("weight", weights), "sources")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    rated = water_fill(sources, words * budget, max_epochs).select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).alias("whole"),
    ).withColumn("needed", F.col("target") - F.col("whole") * F.col("source_size"))

    # Copies of a row are one entry of the order.
    entries = sizes.groupBy("source", "key", "h", "size").agg(F.count(F.lit(1)).alias("copies"))
    entries = entries.withColumn("range", F.pmod("h", F.lit(RANGES))).withColumn("words", F.col("size") * F.col("copies"))
    sums = entries.groupBy("source", "range").agg(F.sum("words").alias("words"))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(rated, F.col("source").eqNullSafe(F.col("s")))
        .select("s", F.col("range").alias("r"), "before", "source_size", "target", "whole", "needed")
    )
    within = W.partitionBy("source", "range").orderBy("h", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = entries.withColumn("inside", F.coalesce(F.sum("words").over(within), F.lit(0))).join(
        ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))
    )
    # A copy belongs to the needed words when its middle does.
    left = F.col("needed") - F.col("before") - F.col("inside")
    reached = F.when(F.col("size") > 0, F.floor(left / F.col("size") + 0.5)).when(left >= 0, F.col("copies")).otherwise(F.lit(0))
    extra = F.when(F.col("needed") > 0, F.greatest(F.lit(0), F.least(reached, F.col("copies")))).otherwise(F.lit(0))
    return placed.select(
        "key",
        "source",
        "h",
        "size",
        "copies",
        "source_size",
        "target",
        F.col("whole").alias("repetitions"),
        extra.cast("long").alias("extra"),
    )


def row_hash(key: str, text: str, seed: int = SEED) -> Column:
    """The seeded place of a document in its source."""
    return F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, columns as they were."""
    plan = mixing_plan(docs, key, text, source, **options)
    h, times, k, s, plan_h, extra, copies, place = free_names(
        docs, "__h", "__times", "__key", "__source", "__plan_h", "__extra", "__copies", "__place"
    )
    taken = plan.where("repetitions + extra > 0").select(
        F.col("key").alias(k),
        F.col("source").alias(s),
        F.col("h").alias(plan_h),
        F.col("repetitions").alias(times),
        F.col("extra").alias(extra),
        F.col("copies").alias(copies),
    )
    decisions = stage(taken, "mix-decisions")
    hashed = docs.withColumn(h, row_hash(key, text, options.get("seed", SEED)))
    same = (
        (F.col(h) == F.col(plan_h))
        & F.col(f"`{key}`").eqNullSafe(F.col(k))
        & F.col(f"`{source}`").eqNullSafe(F.col(s))
    )
    in_part = (F.col(extra) > 0) & (F.col(extra) < F.col(copies))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = hashed.join(decisions.where(~in_part), same).select(
        *columns, (F.col(times) + (F.col(extra) > 0).cast("long")).alias(times)
    )
    parts = decisions.where(in_part)
    if not parts.isEmpty():
        # At most one entry of each source; its rows are numbered, however many there are.
        rows = stage(hashed.join(parts, same), "mix-parts")
        numbered = with_group_position(rows, [plan_h, s, k], [], place)
        some = numbered.select(*columns, (F.col(times) + (F.col(place) <= F.col(extra)).cast("long")).alias(times))
        whole = whole.unionAll(some.where(F.col(times) > 0))
    return whole.select(*columns, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(h)).drop(h)
