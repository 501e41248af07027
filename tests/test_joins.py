import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableloom.operators import bucketed, joins
from tableloom.plans.federated import sql_join
from tableloom.staging import new_path

HOWS = ["inner", "left", "right", "full", "left_semi", "left_anti"]


def brute(left, right, how):
    """Nested loops over small lists of (key, payload)."""
    out = []
    for l in left:
        partners = [r for r in right if l[0] is not None and l[0] == r[0]]
        if how == "left_semi":
            out += [l] if partners else []
        elif how == "left_anti":
            out += [] if partners else [l]
        else:
            out += [l + r for r in partners]
            if not partners and how in ("left", "full"):
                out.append(l + (None, None))
    if how in ("right", "full"):
        keys = {l[0] for l in left}
        out += [(None, None) + r for r in right if r[0] is None or r[0] not in keys]
    return Counter(out)


@pytest.fixture(scope="module")
def sides(spark):
    random.seed(3)
    # A third of the rows share a key, another part has none, and copies occur.
    left = [(random.choice([0, 0, 0, None, 1, 2, 3, 4, 5, 6]), random.randint(0, 4)) for _ in range(90)]
    right = [(random.choice([0, 0, None, 2, 3, 7, 8, 9]), random.randint(0, 4)) for _ in range(60)]
    return (
        left,
        right,
        spark.createDataFrame(left, "k int, v int").repartition(3),
        spark.createDataFrame(right, "k int, w int").repartition(3),
    )


@pytest.mark.parametrize("skew_safe", [True, False])
@pytest.mark.parametrize("how", HOWS)
def test_join_types(sides, how, skew_safe):
    left, right, l, r = sides
    got = joins.equi_join(l, r, "k", "k", how, skew_safe=skew_safe)
    assert Counter(tuple(x) for x in got.collect()) == brute(left, right, how)


@pytest.mark.parametrize("hot_rows", [1, 4, 1000])
@pytest.mark.parametrize("how", HOWS)
def test_salted_equals_plain(sides, how, hot_rows):
    left, right, l, r = sides
    got = joins.equi_join(l, r, "k", "k", how, hot_rows=hot_rows)
    assert Counter(tuple(x) for x in got.collect()) == brute(left, right, how)


@pytest.mark.parametrize("counted", [["left"], ["right"], []])
@pytest.mark.parametrize("how", HOWS)
def test_counting_some_sides_only(sides, counted, how):
    left, right, l, r = sides
    got = joins.equi_join(l, r, "k", "k", how, skew_safe=counted, hot_rows=3)
    assert Counter(tuple(x) for x in got.collect()) == brute(left, right, how)


def test_only_the_largest_hot_keys_are_salted(sides, monkeypatch):
    from tableloom.operators import skew

    monkeypatch.setattr(joins, "hot_keys", lambda df, keys, rows: skew.hot_keys(df, keys, rows, 2))
    left, right, l, r = sides
    got = joins.equi_join(l, r, "k", "k", "full", hot_rows=1)
    assert Counter(tuple(x) for x in got.collect()) == brute(left, right, "full")


def test_salting_spreads_copies_of_one_row(spark):
    from tableloom.operators.skew import salt

    df = spark.range(4000, numPartitions=8).select(F.lit(1).alias("k"))
    counts = df.select(salt(df, 8).alias("s")).groupBy("s").count().collect()
    assert len(counts) == 8 and max(c["count"] for c in counts) == 500


def test_bad_configuration_is_refused(sides):
    _, _, l, r = sides
    for bad in (("k", "k", "cross"), ("k", "nope", "inner"), (["k", "v"], ["k"], "inner"), ([], [], "inner")):
        with pytest.raises(ValueError):
            joins.equi_join(l, r, *bad)


def test_against_pandas(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 250000")
    orders = orders.select("o_custkey", "o_orderkey")
    l, r = customer.toPandas(), orders.toPandas()
    for how, other in (("inner", "inner"), ("left", "left"), ("right", "right"), ("full", "outer")):
        expected = pd.merge(l, r, how=other, left_on="c_custkey", right_on="o_custkey")
        assert joins.equi_join(customer, orders, "c_custkey", "o_custkey", how).count() == len(expected)


def test_names_that_differ_in_case_only(spark):
    df = spark.createDataFrame([(1, 2)], "Id int, v int")
    assert joins.equi_join(df, df, "id", "ID").columns == ["Id_1", "v_1", "Id", "v"]


def test_broadcast_only_below_the_limits(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    assert joins.is_small(nation, 25, 10_000)
    assert not joins.is_small(nation, 24, 10_000)
    assert not joins.is_small(nation, 25, 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = joins.broadcast_join(customer, nation, "c_nationkey", "n_nationkey")
        large = joins.broadcast_join(customer, nation, "c_nationkey", "n_nationkey", max_rows=3)
        assert "BroadcastHashJoin" in plan(small) and "BroadcastHashJoin" not in plan(large)
        assert small.count() == large.count() == customer.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plain_joins_look_for_no_keys(spark, sf_dir):
    """Adaptive execution splits both sides of an inner join, so nothing runs before it does."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("inner", "inner")
    joins.equi_join(customer, orders, "c_custkey", "o_custkey")
    jobs = list(tracker.getJobIdsForGroup("inner"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == []


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_a_shuffle(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    left = bucketed.write_bucketed(lines, "bucketed_lines", ["l_orderkey"], 4)
    right = bucketed.write_bucketed(orders, "bucketed_orders", ["o_orderkey"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = bucketed.bucketed_join(left, right)
        assert "SortMergeJoin" in plan(both) and "Exchange" not in plan(both)
        assert both.count() == lines.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_grow_with_the_rows(spark):
    wide, narrow = spark.range(1000).toDF("k"), spark.range(900).toDF("j")
    assert bucketed.buckets_for([wide, narrow], 8) == 8
    buckets = bucketed.buckets_for([narrow, wide], 8, bucket_rows=20)
    assert buckets == 64
    a, b = bucketed.write_bucketed(wide, "many_k", ["k"], buckets), bucketed.write_bucketed(narrow, "many_j", ["j"], buckets)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = bucketed.bucketed_join(a, b)
        assert "Exchange" not in plan(both)
        tasks = both.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count"), F.sum("count")).first()
        assert tasks[0] < 60 and tasks[1] == 900
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hot_left,hot_right", [(5, 1000), (1000, 5), (5, 5), (1, 1)])
def test_bucketed_join_with_hot_keys(sides, hot_left, hot_right):
    left, right, l, r = sides
    mark = f"{hot_left}_{hot_right}"
    a = bucketed.write_bucketed(l, f"hot_left_{mark}", ["k"], 3, hot_rows=hot_left)
    b = bucketed.write_bucketed(r, f"hot_right_{mark}", ["k"], 3, hot_rows=hot_right)
    got = bucketed.bucketed_join(a, b)
    assert got.columns == ["k_1", "v", "k", "w"]
    assert Counter(tuple(x) for x in got.collect()) == brute(left, right, "inner")
    assert Counter(tuple(x) for x in a.whole().collect()) == Counter(left)


def test_bucketed_table_is_opened_again(spark, sides, tmp_path):
    left, right, l, r = sides
    paths = [str(tmp_path / "l"), str(tmp_path / "r")]
    bucketed.write_bucketed(l, "again_l", ["k"], 3, paths[0] + "/", hot_rows=5)
    bucketed.write_bucketed(r, "again_r", ["k"], 3, paths[1], hot_rows=1000)
    a = bucketed.open_bucketed(spark, "again_l", ["k"], paths[0])
    b = bucketed.open_bucketed(spark, "again_r", ["k"], paths[1])
    assert a.aside is not None
    got = bucketed.bucketed_join(a, b)
    assert Counter(tuple(x) for x in got.collect()) == brute(left, right, "inner")


def test_mapped_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    right = spark.createDataFrame([(2, "p"), (2, "q"), (3, "r")], "key int, y string")
    columns = [
        joins.MappedColumn("k", "id", "key"),
        joins.MappedColumn("right_y", right="y"),
        joins.MappedColumn("left_x", left="x"),
    ]
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(joins.mapped_join(left, right, "id", "key", columns)) == [(1, None, "a"), (2, "p", "b"), (2, "q", "b")]
    assert (3, "r", None) in rows(joins.mapped_join(left, right, "id", "key", columns, "full"))
    # With nothing on the left the right rows come out, keys filled from the right.
    empty = joins.mapped_join(left.limit(0), right, "id", "key", columns, "full")
    assert rows(empty) == [(2, "p", None), (2, "q", None), (3, "r", None)]
    with pytest.raises(ValueError):
        joins.mapped_join(left, right, "id", "key", [joins.MappedColumn("none")])


def test_sql_join_keeps_its_views_private(spark):
    left = spark.createDataFrame([(1, "a")], "id int, x string")
    right = spark.createDataFrame([(1, "{b}")], "id int, y string")
    got = sql_join(left, right, "WITH r2 AS (SELECT * FROM right) SELECT * FROM left l JOIN r2 ON l.id == r2.id;")
    assert got.columns == ["id_1", "x", "id", "y"]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("left", "right"))]
    assert [tuple(r) for r in got.collect()] == [(1, "a", 1, "{b}")]
    got.write.parquet(new_path(spark, "sql_join"))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 300000")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    both = joins.equi_join(customer, orders, "c_custkey", "o_custkey", "left").select("c_name", "o_orderkey")
    text = plan(both)
    assert "GreaterThan(o_totalprice,300000.0)" in text
    assert "o_orderpriority" not in text and "c_mktsegment" not in text


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("key", [7, None])
def test_a_hot_optional_side_fills_many_partitions(spark, how, key):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        left = spark.range(400, numPartitions=4).select(F.col("id").alias("k"))
        # A third of the rows has one key, and they are copies of each other.
        hot = F.col("id") % 3 == 0
        right = spark.range(60_000, numPartitions=12).select(
            F.when(hot, F.lit(key).cast("long")).otherwise(F.col("id") % 500).alias("j"),
            F.when(hot, 0).otherwise(F.col("id")).alias("w"),
        )
        sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        safe = sizes(joins.equi_join(left, right, "k", "j", how, hot_rows=1_000))
        plain = sizes(joins.equi_join(left, right, "k", "j", how, skew_safe=False))
        assert sum(safe) == sum(plain)
        if key is not None or how in ("right", "full"):
            assert max(plain) > 20_000 and max(safe) < 9_000
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
