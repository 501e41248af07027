"""Sharding by extendible hashing: only buckets over the byte limit take another hash bit.

A row's hash is written in hexadecimal: 128 bits of its key, then 128 bits of its row number,
so even copies of one key can be told apart. A round looks at 16 more bits. It sums bytes by
the 16-bit cell, adds cells up to buckets of every depth from 0 to 16, and gives each cell the
shortest prefix whose bucket fits. Cells without one go to the next round with their rows.

Nothing is collected: the driver only learns whether a round left cells over. The table of a
first round has at most 65 536 cells, so it may be broadcast; later ones are joined by key.

Defined results: a NULL key counts as the empty text, a NULL size as 0; copies are separate
rows; a single row above the limit is a shard of its own; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.text import free_names
from tableloom.staging import stage

SHARD_BYTES = 64 << 20  # production limit of one shard: bytes of text
ROUND_BITS = 16
_DIGITS = ROUND_BITS // 4
_ROUNDS = 256 // ROUND_BITS


def _leaves(rows: DataFrame, limit: int) -> DataFrame:
    """For each (parent, cell): its depth in this round and its bucket's bytes and rows.

    ``depth`` is NULL where even 16 bits do not bring the bucket under the limit.
    """
    cells = rows.groupBy("parent", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    depths = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(ROUND_BITS)))).withColumn(
        "bucket", F.expr(f"shiftright(cell, {ROUND_BITS} - depth)")
    )
    fits = (
        depths.groupBy("parent", "depth", "bucket")
        .agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        .where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    )
    return depths.join(fits, ["parent", "depth", "bucket"], "left").groupBy("parent", "cell").agg(
        F.min_by(
            F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "bucket", "shard_bytes", "shard_rows")),
            F.when(F.col("shard_bytes").isNotNull(), F.col("depth")),
        ).alias("best")
    ).select("parent", "cell", "best.*")


def extendible_shards(df: DataFrame, key: str, size: Column, limit: int = SHARD_BYTES) -> DataFrame:
    """``df`` with ``shard``, ``depth``, ``shard_bytes`` and ``shard_rows``.

    ``shard`` names the directory entry: the whole hexadecimal prefix of earlier rounds, a
    slash, and the bits of the last one. Pass narrow rows (key and size): they are staged once,
    so that row numbers are the same whenever a lost task is repeated.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    out = free_names(df, "shard", "depth", "shard_bytes", "shard_rows")
    rows = df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)],
        F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
        F.concat(
            F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))),
            F.md5(F.monotonically_increasing_id().cast("string")),
        ).alias("hash"),
    )
    left = stage(rows, "shard-rows")
    parts = []
    for number in range(_ROUNDS):
        at = number * _DIGITS
        now = left.withColumn("parent", F.substring("hash", 1, at)).withColumn(
            "cell", F.conv(F.substring("hash", at + 1, _DIGITS), 16, 10).cast("int")
        )
        leaves = stage(_leaves(now, limit), "shard-leaves")
        found = leaves.where("depth IS NOT NULL")
        joined = now.join(F.broadcast(found) if number == 0 else found, ["parent", "cell"])
        bits = F.expr("lpad(bin(bucket), depth, '0')")
        parts.append(
            joined.select(
                *[F.col(n).alias(c) for n, c in zip(names, df.columns)],
                F.concat("parent", F.lit("/"), bits).alias(out[0]),
                (F.col("depth") + at * 4).alias(out[1]),
                F.col("shard_bytes").alias(out[2]),
                F.col("shard_rows").alias(out[3]),
            )
        )
        over = leaves.where("depth IS NULL")
        if over.isEmpty():
            break
        left = stage(now.join(over.select("parent", "cell"), ["parent", "cell"], "left_semi").drop("parent", "cell"), "shard-rows")
    return reduce(DataFrame.unionAll, parts)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard below ``path``; a shard fits one task because it fits its limit."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
