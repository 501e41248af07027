"""Finding and spreading hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.staging import stage_unless_empty

# A key with this many rows is hot; fewer rows are no burden for one task. It decides on the
# route of a key only, never on a result.
HOT_ROWS = 1_000_000
# How often a hot key is expected in the sample that looks for it.
EXPECTED = 1_000


def spread(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A number per row that scatters rows and that a retried task computes again.

    ``columns`` names those to hash, so that a plan reads no others. The partition number
    keeps exact copies of a row apart, and row order plays no part. The hash is brought
    below 2**62 first, so that adding to it cannot overflow.
    """
    narrow = df if columns is None else df.select(*[f"`{c}`" for c in dict.fromkeys(columns)])
    return F.pmod(F.xxhash64(*hashable(narrow)), F.lit(1 << 62)) + F.spark_partition_id()


def salt(df: DataFrame, buckets: int, columns: Sequence[str] | None = None) -> Column:
    return F.pmod(spread(df, columns), F.lit(buckets))


def hashable(df: DataFrame) -> list[Column]:
    """The columns Spark can hash: all but those with maps in them."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)]


def _has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return _has_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_has_map(f.dataType) for f in data_type.fields)
    return False


def hot_keys(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, most: int | None = None
) -> DataFrame:
    """All keys with at least ``hot_rows`` rows, and how many; or the ``most`` largest of them.

    A thin sample names candidates, so that the counts of all keys need not be shuffled; the
    candidates are then counted in full. Both results are written, so nothing is computed
    twice, and without a candidate the sample is the only job. Only the route of a key depends
    on this, never whether its rows are in a result.
    """
    narrow = df.select(*keys)
    rate = min(1.0, EXPECTED / hot_rows)
    nothing = narrow.limit(0).withColumn("rows", F.lit(0).cast("long"))
    if rate < 1.0:
        names = [f"__c{i}" for i in range(len(keys))]
        # A hot key is expected EXPECTED times; half as often is some 15 deviations away.
        often = _counts(narrow.sample(rate, seed=7), keys, EXPECTED // 2, None)
        seen = stage_unless_empty(often.select(*[F.col(k).alias(n) for k, n in zip(keys, names)]), "candidates")
        if seen is None:
            return df.sparkSession.createDataFrame([], nothing.schema)
        same = F.lit(True)
        for key, name in zip(keys, names):
            same = same & F.col(key).eqNullSafe(F.col(name))
        # Their size is known from the files, so Spark broadcasts them if they are small.
        narrow = narrow.join(seen, same, "left_semi")
    found = stage_unless_empty(_counts(narrow, keys, hot_rows, most), "hot-keys")
    return df.sparkSession.createDataFrame([], nothing.schema) if found is None else found


def _counts(df: DataFrame, keys: Sequence[str], least: int, most: int | None) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)
    # The keys break ties, so that the same ones are found again.
    return counts if most is None else counts.orderBy(F.col("rows").desc(), *keys).limit(most)


def has_hot_key(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> bool:
    return not hot_keys(df, keys, hot_rows, 1).isEmpty()


def salted_aggregate(
    df: DataFrame, keys: Sequence[str], aggregates: dict[str, tuple[str, str]], salts: int = 16
) -> DataFrame:
    """Aggregate per key and salt, then per key.

    ``aggregates`` maps an output name to (function, column); functions are sum, count,
    min, max and avg. Spark combines these in each task before the shuffle, so a plain
    aggregate sends one row per key and task. Salting pays when even those rows are too many
    for one task, that is with very many tasks; it costs a second, small shuffle.
    """
    partial: list[Column] = []
    final: list[Column] = []
    for name, (function, column) in aggregates.items():
        source = F.col(column)
        if function in ("sum", "min", "max"):
            combine = getattr(F, function)
            partial.append(combine(source).alias(f"__{name}"))
            final.append(combine(f"__{name}").alias(name))
        elif function == "count":
            partial.append(F.count(source).alias(f"__{name}"))
            final.append(F.sum(f"__{name}").alias(name))
        elif function == "avg":
            partial += [F.sum(source).alias(f"__{name}_s"), F.count(source).alias(f"__{name}_n")]
            total, rows = F.sum(f"__{name}_s"), F.sum(f"__{name}_n")
            final.append(F.try_divide(total.cast("double"), rows).alias(name))
        else:
            raise ValueError(f"cannot combine {function!r} in two phases")
    needed = [*keys, *[column for _, column in aggregates.values()]]
    salted = df.withColumn("__salt", salt(df, salts, needed))
    return salted.groupBy(*keys, "__salt").agg(*partial).groupBy(*keys).agg(*final)
