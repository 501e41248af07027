"""Tables laid out so that joining them needs no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.names import unique_names
from tableloom.operators.joins import equi_join
from tableloom.operators.skew import HOT_ROWS, hot_keys
from tableloom.staging import new_path, path_exists, stage


# Folders inside the table's own: the hot keys and their rows. Spark passes over names that begin
# with an underscore when it reads the table, and they go when the table's folder goes.
HOT, ASIDE = "/_hot_keys", "/_hot_rows"
# One task sorts a bucket in memory, and nothing merges or splits it afterwards.
BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 100_000  # Spark's own limit


@dataclass(frozen=True)
class BucketedTable:
    """A bucketed table and, in its folder, the rows of hot keys, which no bucket could hold."""

    table: DataFrame
    keys: tuple[str, ...]
    hot: DataFrame | None = None
    aside: DataFrame | None = None

    def whole(self) -> DataFrame:
        return self.table if self.aside is None else self.table.unionAll(self.aside)


def buckets_for(tables: Sequence[DataFrame], least: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """A number of buckets for tables that will be joined: ``least``, doubled while the largest one needs more.

    Tables with equal numbers meet bucket by bucket, so all of them take the same.
    """
    rows, buckets = max(df.count() for df in tables), least
    while rows > buckets * bucket_rows and 2 * buckets <= MOST_BUCKETS:
        buckets *= 2
    return buckets


def write_bucketed(
    df: DataFrame,
    table: str,
    keys: Sequence[str],
    buckets: int,
    path: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> BucketedTable:
    """Save ``df`` bucketed and sorted by ``keys``; rows of hot keys go to plain files.

    A bucket is read by one task, and no adaptive rule can split it, so keys of ``hot_rows``
    rows or more, NULL included, stay out.
    """
    spark = df.sparkSession
    path = (path or new_path(spark, table)).rstrip("/")
    found = hot_keys(df, keys, hot_rows).select(*keys)
    hot = aside = None
    if not found.isEmpty():
        # One marked pass over the input; both parts are cut from what it wrote.
        marks = [f"__h{i}" for i in range(len(keys))]
        few = found.select(*[F.col(k).alias(m) for k, m in zip(keys, marks)], F.lit(True).alias("__hot"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marks)])
        marked = stage(df.join(few, same, "left").select(*[f"`{c}`" for c in df.columns], "__hot"), "marked")
        hot, aside = found, marked.where("__hot").drop("__hot")
        df = marked.where("__hot IS NULL").drop("__hot")
    # Rows of one bucket come together first: one file per bucket instead of one per task.
    (
        df.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .saveAsTable(table)
    )
    if hot is not None:
        hot.write.parquet(path + HOT)
        aside.write.parquet(path + ASIDE)
    return open_bucketed(spark, table, keys, path)


def open_bucketed(spark: SparkSession, table: str, keys: Sequence[str], path: str) -> BucketedTable:
    """A table written before, with the rows set aside in its folder."""
    path = path.rstrip("/")
    rows = spark.table(table)
    hot = aside = None
    if path_exists(spark, path + HOT):
        hot = spark.read.schema(rows.select(*keys).schema).parquet(path + HOT)
        aside = spark.read.schema(rows.schema).parquet(path + ASIDE)
    return BucketedTable(rows, tuple(keys), hot, aside)


def bucketed_join(left: BucketedTable, right: BucketedTable, repair: str = "suffix") -> DataFrame:
    """Inner join on the bucket keys. Only rows that meet a hot key are shuffled."""
    names = left.table.columns + right.table.columns
    parts = [_equal(left.table, right.table, left.keys, right.keys)]
    if left.aside is not None:
        met = _keep(right.whole(), right.keys, left.hot, left.keys, "left_semi")
        parts.append(equi_join(left.aside, met, left.keys, right.keys))
    if right.aside is not None:
        met = _keep(left.table, left.keys, right.hot, right.keys, "left_semi")
        parts.append(equi_join(met, right.aside, left.keys, right.keys))
    return reduce(DataFrame.unionAll, parts).toDF(*unique_names(names, repair))


def _equal(left: DataFrame, right: DataFrame, left_keys, right_keys) -> DataFrame:
    return equi_join(left, right, left_keys, right_keys, skew_safe=False)


def _keep(df: DataFrame, keys, hot: DataFrame, hot_names, how: str) -> DataFrame:
    """Rows of ``df`` whose key is, or is not, among the hot keys, which are read from files."""
    marks = [f"__h{i}" for i in range(len(keys))]
    few = hot.select(*[F.col(n).alias(m) for n, m in zip(hot_names, marks)])
    same = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marks)]
    return df.join(few, reduce(lambda a, b: a & b, same), how)
