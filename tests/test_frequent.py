"""Frequent values and frequent combinations: exact by bounded summaries."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableloom.operators import combine, heavy


def ordered(values, top):
    counts = Counter(values)
    return sorted(counts.items(), key=lambda e: (-e[1], e[0] is not None, e[0] or 0))[:top]


@pytest.mark.parametrize("tracked", [8, 64, heavy.TRACKED])
def test_most_frequent_is_exact(spark, tracked):
    rng = random.Random(1)
    values = [int(rng.paretovariate(0.6)) % 5000 for _ in range(6000)] + [None] * 700 + [7] * 3
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(5)
    for top in (1, 5, 40):
        assert heavy.most_frequent(df, "x", top, tracked) == (ordered(values, top), len(values))


def test_flat_counts_need_larger_summaries(spark, monkeypatch):
    """No summary can prove the order of values that all occur equally often, so all are counted in the end."""
    values = [f"v{i:04d}" for i in range(3000)] * 2
    df = spark.createDataFrame([(v,) for v in values], "x string")
    monkeypatch.setattr(heavy, "MAX_TRACKED", 600)
    assert heavy.most_frequent(df, "x", 10, 16) == (ordered(values, 10), 6000)
    assert heavy.most_frequent(df.limit(0), "x", 3) == ([], 0)
    floats = spark.createDataFrame([(0.5,), (0.5,), (None,)], "x double")
    assert heavy.most_frequent(floats, "x", 2) == ([(0.5, 2), (None, 1)], 3)


def test_the_second_pass_sends_on_candidates_only(spark):
    df = spark.range(0, 100_000, 1, 4).selectExpr("CAST(IF(id % 3 = 0, id % 5, id) AS STRING) AS value")
    counted = heavy.candidate_counts(df, ["0", "3"], df.schema["value"].dataType)
    assert counted.count() == 2
    plan = counted._jdf.queryExecution().executedPlan().toString()
    # Read upwards: the look-up comes before the partial counts and these before the shuffle.
    order = [plan.index(part) for part in ("hashpartitioning(value", "partial_count", "BroadcastHashJoin")]
    assert order == sorted(order)


@pytest.mark.parametrize("size", [1, 2, 3, 4])
@pytest.mark.parametrize("least", [1, 3])
@pytest.mark.parametrize("buckets", [1 << 18, 20])
def test_grown_combinations(spark, monkeypatch, size, least, buckets):
    monkeypatch.setattr(combine, "BUCKETS", buckets)
    rng = random.Random(size)
    baskets = {g: set(rng.choices("abcdefgh", k=rng.randint(0, 6))) for g in range(25)}
    rows = [(g, i) for g, items in baskets.items() for i in items] * 2 + [(1, None)]
    df = spark.createDataFrame(rows, "g long, i string")
    found = {tuple(r["items"]): r["support"] for r in combine.item_combinations(df, "g", "i", size, None, least, mask_items=2).collect()}
    wanted = Counter(c for items in baskets.values() for c in itertools.combinations(sorted(items), size))
    assert found == {c: n for c, n in wanted.items() if n >= least}


@pytest.mark.parametrize("task_rows", [3, 12, 40])
@pytest.mark.parametrize("size", [1, 2, 3])
def test_combinations_in_bounded_tasks(spark, monkeypatch, size, task_rows):
    """The same from few rows a task, with groups and items of more rows than that, and with none."""
    monkeypatch.setattr(combine, "TASK_ROWS", task_rows)
    rng = random.Random(size)
    baskets = {g: set(rng.sample(range(60), rng.choice([2, 3, 9]))) | ({99} if g % 2 else set()) for g in range(30)}
    rows = [(g or None, i) for g, items in baskets.items() for i in items] * 2
    df = spark.createDataFrame(rows, "g long, i long")
    result = combine.item_combinations(df, "g", "i", size, min_support=2, mask_items=2)
    wanted = Counter(c for items in baskets.values() for c in itertools.combinations(sorted(items), size))
    assert {tuple(r["items"]): r["support"] for r in result.collect()} == {c: n for c, n in wanted.items() if n >= 2}


def test_tasks_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(combine, "TASK_ROWS", 100)
    # A hundred groups of ten items: 4500 pairs, of which every one is held twice.
    df = spark.range(1000).select((F.col("id") / 10).cast("long").alias("g"), (F.col("id") % 500).alias("i"))
    found = combine.item_combinations(df, "g", "i", 2, min_support=2)
    per_task = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert per_task[1] == 2250 and per_task[0] < 150
