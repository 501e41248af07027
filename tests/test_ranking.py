import random
from collections import defaultdict, deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableloom.operators import aggregates, combine, ranking, skew


def rows(df):
    return [tuple(r) for r in df.collect()]


@given(values=st.lists(st.integers(0, 5), min_size=1, max_size=60))
@settings(max_examples=10, deadline=None)
def test_positions_with_ties_and_copies(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
    placed = sorted((p, v) for v, p in rows(ranking.with_position(df, ["v"])))
    assert [p for p, _ in placed] == list(range(1, len(values) + 1))
    assert [v for _, v in placed] == sorted(values)


def test_positions_span_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("v"))
        placed = ranking.with_position(df, [F.col("v").desc()], unique=True)
        assert placed.select(F.spark_partition_id()).distinct().count() >= 1
        expected = {v: i + 1 for i, v in enumerate(sorted((i * 7919 % 5003 for i in range(5000)), reverse=True))}
        assert dict(rows(placed)) == expected
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_of_one_row_fill_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(8000, numPartitions=16).select(F.lit(1).alias("v"))
        numbered = ranking._numbered(df, [F.col("v")], unique=False)
        sizes = [n for _, n in rows(numbered.groupBy("__part").count())]
        assert len(sizes) >= 3 and max(sizes) < 6000
        assert sorted(p for _, p in rows(ranking.with_position(df, ["v"]))) == list(range(1, 8001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("group_rows", [1, 1_000_000])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_group_positions_with_a_hot_key(spark, group_rows, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        random.seed(5)
        data = [(random.choice(["hot", "hot", None, f"k{i % 40}"]), i * 31 % 1009, i) for i in range(900)]
        df = spark.createDataFrame(data, "k string, o int, id int").repartition(5)
        got = ranking.with_group_position(
            df, ["k"], ["o", "id"], "p", {"first_id": "id", "first_o": "o"}, group_rows=group_rows
        )
        groups = defaultdict(list)
        for k, o, i in data:
            groups[k].append((o, i))
        expected = {
            (k, o, i, place, min(g)[1], min(g)[0])
            for k, g in groups.items()
            for place, (o, i) in enumerate(sorted(g), start=1)
        }
        found = rows(got)
        assert len(found) == len(data) and set(found) == expected
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("small", [10_000, 0])
def test_slices(spark, monkeypatch, small):
    monkeypatch.setattr(ranking, "SMALL_SLICE", small)
    df = spark.range(100).select(F.col("id").alias("v"))
    slice_of = lambda *a: sorted(v for v, in rows(ranking.row_slice(df, ["v"], *a)))
    assert slice_of(0, 0) == list(range(100))
    assert slice_of(10, 13) == [10, 11, 12]
    assert slice_of(97, 0) == [97, 98, 99]
    assert slice_of(5, 5) == []
    with pytest.raises(ValueError):
        ranking.row_slice(df, ["v"], 5, 4)


@pytest.mark.parametrize("small", [10_000, 0])
def test_top_n(spark, monkeypatch, small):
    monkeypatch.setattr(ranking, "SMALL_SLICE", small)
    df = spark.range(200, numPartitions=3).select((F.col("id") * 7 % 50).alias("v"), "id")
    top = ranking.top_n(df, [F.col("v").desc(), "id"], 30)
    expected = sorted(((i * 7 % 50, i) for i in range(200)), key=lambda r: (-r[0], r[1]))[:30]
    assert rows(top) == expected


def test_slots_sorted_by_last_column_first(spark):
    slots = [(1, 4, 8, 1), (2, 5, 9, 6), (3, 7, 2, 1), (4, 7, 3, 1), (5, 4, 8, 1), (6, 2, 8, 6), (7, 4, 8, 1)]
    df = spark.createDataFrame(slots, "id int, a int, b int, c int")
    order = [F.col(c).desc() for c in ("c", "b", "a")] + [F.col("id")]
    placed = sorted((p, i) for i, _, _, _, p in rows(ranking.with_position(df, order)))
    assert [i for _, i in placed] == [2, 6, 1, 5, 7, 4, 3]


@pytest.mark.parametrize("pruned_k", [1000, 1])
def test_top_k_sum(spark, monkeypatch, pruned_k):
    monkeypatch.setattr(ranking, "PRUNED_K", pruned_k)
    df = spark.createDataFrame([("a", v) for v in (4, 17, 8, 26, 3, 19, -2, 12)] + [("b", 5)], "g string, v int")
    assert dict(rows(ranking.top_k_sum(df, ["g"], "v", 4))) == {"a": 74, "b": 5}


def simulate(backlog):
    """A queue that holds one task per tenant and refills from the tenant's own queue."""
    fair, waiting, active = deque(), defaultdict(deque), set()
    for tenant, task in backlog:
        if tenant in active:
            waiting[tenant].append((tenant, task))
        else:
            active.add(tenant)
            fair.append((tenant, task))
    while fair:
        tenant, task = fair.popleft()
        yield task
        if waiting[tenant]:
            fair.append(waiting[tenant].popleft())


@pytest.mark.parametrize("group_rows", [3, 1_000_000])
def test_fair_interleave_matches_the_queue(spark, group_rows):
    random.seed(11)
    backlog = [(random.choice("aaaaabcde"), i) for i in range(300)]
    df = spark.createDataFrame(backlog, "tenant string, arrival int").repartition(4)
    placed = ranking.fair_interleave(df, "tenant", ["arrival"], group_rows=group_rows)
    order = [r.arrival for r in placed.orderBy("position").collect()]
    assert order == list(simulate(backlog))


@pytest.mark.parametrize("group_rows", [2, 1_000_000])
def test_batches_hold_every_row_once(spark, group_rows):
    data = [("hot" if i % 3 == 0 else f"k{i % 5}", i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, v int").repartition(4)
    lists = aggregates.collect_by_key(df, "k", ["v"], ["v"], 7, group_rows=group_rows)
    got = defaultdict(list)
    for r in sorted(lists.collect(), key=lambda r: (r.k, r.batch_no)):
        assert r.n == len(r["items"]) <= 7
        got[r.k] += [int(cells[0]) for cells in r["items"]]
    expected = defaultdict(list)
    for k, v in data:
        expected[k].append(v)
    assert got == expected


def test_keep_last(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, None), (2, 1, None)], "k int, o int, v string")
    assert sorted(rows(aggregates.keep_last(df, ["k"], ["o"]))) == [(1, 3, "c"), (2, 1, None)]


def test_salted_aggregate_equals_plain(spark):
    df = spark.range(3000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.when(F.col("id") % 11 != 0, F.col("id")).alias("v"),
    )
    wanted = {n: (n, "v") for n in ("sum", "count", "min", "max", "avg")}
    plain = df.groupBy("k").agg(*[getattr(F, n)("v").alias(n) for n in wanted])
    assert sorted(rows(skew.salted_aggregate(df, ["k"], wanted, 5))) == sorted(rows(plain))
    with pytest.raises(ValueError):
        skew.salted_aggregate(df, ["k"], {"x": ("median", "v")})


def test_a_salt_next_to_the_largest_number(spark):
    from pyspark.sql.functions import lit

    df = spark.range(10, numPartitions=4).select(lit("x").alias("k"))
    top = df.select((skew.spread(df) + F.lit((1 << 62) - 10)).alias("s"))
    assert top.count() == 10 and top.agg(F.max("s")).first()[0] > 0


def test_a_salted_aggregate_reads_few_columns(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = skew.salted_aggregate(documents, ["lang"], {"n": ("count", "doc_id")})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_a_sample_finds_hot_keys_and_counts_are_exact(spark):
    df = spark.range(90_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 5 == 0, 0).otherwise(F.col("id")).alias("k"),
        F.lit("x").alias("x"),
    )
    # 30 000 NULLs and 12 000 zeros; the sample rate is 1 in 10.
    assert sorted(rows(skew.hot_keys(df, ["k", "x"], 10_000)), key=str) == [(0, "x", 12_000), (None, "x", 30_000)]
    assert rows(skew.hot_keys(df, ["k"], 10_000, 1)) == [(None, 30_000)]
    assert skew.has_hot_key(df, ["k"], 30_000) and not skew.has_hot_key(df, ["k"], 30_001)
    assert not skew.has_hot_key(spark.range(50_000), ["id"])


def test_hot_keys_are_bounded(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    assert rows(skew.hot_keys(df, ["k"], 100)) == [(0, 400)]
    assert rows(skew.hot_keys(df, ["k"], 1, 3)) == [(0, 400), (400, 1), (401, 1)]


def test_pairs(spark):
    df = spark.createDataFrame([(v,) for v in (5, 8, 17, 40, 45, 2, 28, 33, 8)], "v int")
    assert sorted(rows(combine.pairs_with_sum(df, "v", 45))) == [(5, 40), (17, 28)]
    assert sorted(rows(combine.pairs_with_difference(df, "v", 5))) == [(28, 33), (40, 45)]
    with pytest.raises(ValueError):
        combine.pairs_with_difference(df, "v", 0)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_combinations(spark, size):
    from itertools import combinations

    random.seed(2)
    groups = {g: {random.choice("abcdefg") for _ in range(random.randint(1, 6))} for g in range(30)}
    data = [(g, i) for g, items in groups.items() for i in items] * 2
    df = spark.createDataFrame(data + [(0, None)], "g int, i string")
    expected = defaultdict(int)
    for items in groups.values():
        for combo in combinations(sorted(items), size):
            expected[combo] += 1
    got = {tuple(r["items"]): r.support for r in combine.item_combinations(df, "g", "i", size).collect()}
    assert got == expected


@pytest.mark.parametrize("size", [1, 2, 3])
@pytest.mark.parametrize("least", [1, 2, 4])
def test_many_items_give_the_same_as_masks(spark, size, least):
    random.seed(9)
    data = [(random.choice([None, *range(12)]), random.choice([None, *"abcdefgh"])) for _ in range(120)]
    df = spark.createDataFrame(data, "g int, i string")
    routes = [combine.item_combinations(df, "g", "i", size, min_support=least, mask_items=n) for n in (62, 3)]
    first, second = ({tuple(r["items"]): r.support for r in route.collect()} for route in routes)
    assert first == second and all(n >= least for n in first.values())


def test_both_routes_break_ties_alike(spark, monkeypatch):
    df = spark.range(900, numPartitions=5).select((F.col("id") % 7).alias("v"), (F.col("id") * 31 % 101).alias("w"))
    found = []
    for small in (10_000, 0):
        monkeypatch.setattr(ranking, "SMALL_SLICE", small)
        found.append([rows(ranking.top_n(df, ["v"], 200)), sorted(rows(ranking.row_slice(df, ["v"], 50, 333)))])
    assert found[0] == found[1]
    placed = [sorted(rows(ranking.with_group_position(df, ["v"], [F.lit(1)], "p", group_rows=n))) for n in (10, 1_000_000)]
    assert placed[0] == placed[1]


def test_combinations_of_a_catalogue(spark):
    df = spark.range(100).select(F.lit(1).alias("g"), F.col("id").alias("i"))
    assert combine.item_combinations(df, "g", "i", 2).count() == 100 * 99 // 2
    wide = combine.item_combinations(df.where("i < 62"), "g", "i", 2)
    assert wide.count() == 62 * 61 // 2
    some = spark.createDataFrame([(3,), (99,)], "i long")
    assert rows(combine.item_combinations(df, "g", "i", 2, some)) == [([3, 99], 1)]
    assert combine.item_combinations(df.limit(0), "g", "i", 2).count() == 0
