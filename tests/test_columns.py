import json

import pytest
from pyspark.sql import functions as F

from tableloom.operators import aggregates, columns, steps


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rename(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert columns.rename_all(df, ["x", "y"]).columns == ["x", "y"]
    with pytest.raises(ValueError):
        columns.rename_all(df, ["x"])


def test_filter_takes_quotes_and_types(spark):
    df = spark.createDataFrame([("it's", 1), ("x", 2)], "`the name` string, n long")
    assert rows(columns.filter_eq(df, "the name", "it's")) == [("it's", 1)]
    assert rows(columns.filter_eq(df, "n", "2")) == [("x", 2)]


def test_blanks(spark):
    df = spark.createDataFrame([("  ", "", 0), (" a", None, 1)], "s string, t string, n int")
    assert rows(columns.blank_to_null(df)) == [(" a", None, 1), (None, None, 0)]
    assert rows(columns.blank_to_null(df, ["t"])) == [("  ", None, 0), (" a", None, 1)]


def test_key_json(spark):
    df = spark.createDataFrame([(1, "  ", 2.5), (2, "a", None)], "id int, name string, n double")
    got = [(r.key, json.loads(r.value)) for r in columns.encode_key_json(df, "id").collect()]
    assert got == [("1", {"id": 1, "n": 2.5}), ("2", {"id": 2, "name": "a"})]
    with pytest.raises(ValueError):
        columns.encode_key_json(df, "nope")


def test_derive_counts(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "t string")
    derived, counts = columns.derive(df, [columns.DerivedColumn("n", "try_cast(t AS int)", ("t",)),
                                          columns.DerivedColumn("m", "zz + 1", ("zz",))])
    assert rows(derived) == [("1", 1, None), ("x", None, None), (None, None, None)]
    first, second = counts.report()
    assert (first.applied, first.failed, first.missing) == (2, 1, ())
    assert (second.applied, second.failed, second.missing) == (0, 3, ("zz",))


def test_column_sizes(spark):
    df = spark.createDataFrame([("abc", 1000), (None, -5)], "s string, n int").withColumn("z", F.lit(None).cast("string"))
    assert rows(columns.column_sizes(df)) == [("n", 4), ("s", 3), ("z", 0)]


def test_month_filter_reaches_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = aggregates.month_segment_counts(orders, "o_orderdate", "o_orderpriority", "199612")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1996-12-01T00:00" in plan and "LessThan(o_orderdate,1" in plan
    assert "o_totalprice" not in plan


@pytest.mark.parametrize("kind", ["int", "string"])
def test_months_as_numbers_or_text(spark, tmp_path, kind):
    df = spark.createDataFrame([("199603", "a"), ("199603", "b"), ("199604", "a")], "m string, s string")
    path = str(tmp_path / "by_month")
    df.write.partitionBy("m").parquet(path)
    written = spark.read.schema(f"s string, m {kind}").parquet(path)
    counts = aggregates.month_segment_counts(written, "m", "s", "199603")
    assert rows(counts) == [("199603", "a", 1), ("199603", "b", 1)]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(m" in plan and "199603" in plan.split("PartitionFilters")[1][:60]


def test_steps(spark):
    add = steps.Step(lambda df, by: df.withColumn("id", F.col("id") + by), {"by": steps.REQUIRED})
    df = spark.range(2)
    chain = [add.with_inputs(by=steps.Variable("n")), add.with_inputs(by=10)]
    assert rows(steps.run_steps(df, chain, {"n": 1})) == [(11,), (12,)]
    for chain, variables in (([add], {}), ([add.with_inputs(by=steps.Variable("n"))], {})):
        with pytest.raises(ValueError):
            steps.run_steps(df, chain, variables)
    with pytest.raises(ValueError):
        add.with_inputs(other=1)


def test_row_function(spark):
    df = spark.range(100, numPartitions=3)
    got = steps.row_function(df, lambda p: p.assign(sq=p["id"] ** 2), "id long, sq long")
    assert rows(got) == sorted(((i, i * i) for i in range(100)), key=str)
