"""The first lines of text files in the order the files have them, without sorting the data.

A file is read in blocks. One pass counts the lines of every block; running sums over that small
table, files by path and blocks by start, find the block in which the last wanted line lies. Blocks
before it are taken whole, and of it the first lines that are missing. The second pass reads the
same blocks: should Spark have cut the files otherwise by then (say, for more executors), the job
stops with an error instead of giving other lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableloom.staging import stage

FILE, BLOCK, LENGTH, LINE = PLACES = ("__file", "__block", "__length", "__line")


def with_places(df: DataFrame) -> DataFrame:
    """``df``, just read from files, with each line's file, block and order within its block.

    The order asks for every column, so both passes parse all cells and drop the same bad rows.
    """
    parsed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) >= F.lit(-(1 << 63))  # always
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.col("_metadata.file_block_length").alias(LENGTH),
        F.when(parsed, F.monotonically_increasing_id()).alias(LINE),
    )


def first_lines(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a table ``with_places``, filtered or not; the places go."""
    rows = df.drop(*PLACES)
    if n <= 0:
        return rows.limit(0)
    counts = df.groupBy(FILE, BLOCK, LENGTH).agg(F.count(LINE).alias("lines"))
    # One line per block, however long the blocks are.
    earlier = W.orderBy(FILE, BLOCK).rowsBetween(W.unboundedPreceding, -1)
    blocks = stage(counts, "blocks").withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    last = blocks.where(F.col("before") < n).orderBy(F.col("before").desc()).first()
    if last is None or last["before"] + last["lines"] < n:
        return rows
    start, end = last[BLOCK], last[BLOCK] + last[LENGTH]
    same_file = F.col(FILE) == last[FILE]
    same_block = same_file & (F.col(BLOCK) == start) & (F.col(LENGTH) == last[LENGTH])
    overlaps = same_file & (F.col(BLOCK) < end) & (F.col(BLOCK) + F.col(LENGTH) > start) & ~same_block
    # The line numbers keep the filters above the scan: fewer files would be cut into other blocks.
    whole = df.where((F.col(FILE) < last[FILE]) | (same_file & (F.col(BLOCK) < start)) | overlaps).where(
        F.when(overlaps, F.raise_error(F.lit("the blocks of the files have changed, run again"))).otherwise(F.col(LINE) >= 0)
    )
    rest = df.where(same_block).orderBy(LINE).limit(n - last["before"])
    return whole.unionAll(rest).drop(*PLACES)
