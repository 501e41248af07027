"""Folder topics, delivery once, and joins that go on."""

import os
import subprocess
import sys
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableloom.functions.decode import encode_positional
from tableloom.functions.schema import export_schema
from tableloom.plans.configured_join import JoinConfig, Topic
from tableloom.plans.continued_join import ContinuedJoin
from tableloom.sinks.folder_topic import FolderProducer
from tableloom.sinks.ledger import deliver_once, read_delivered, read_ledger
from tableloom.sources.folder_topic import FolderTopic
from tableloom.staging import new_path
from tableloom.streaming.drain import drain_until_finished, entries_taken, file_stream


def numbers(spark, low, high):
    return spark.range(low, high).withColumnRenamed("id", "n")


def test_a_late_entry_holds_back_the_next(spark):
    topic = FolderTopic(new_path(spark, "topic"), numbers(spark, 0, 1).schema)
    producer = FolderProducer(spark, topic.path)
    path, checkpoint = new_path(spark, "out"), new_path(spark, "checkpoint")
    drain = lambda patience: drain_until_finished(spark, topic, None, path, checkpoint, 0.1, patience)
    producer.reserve(3)
    producer.send(numbers(spark, 0, 5), 0)
    producer.send(numbers(spark, 10, 15), 2)
    # Nothing more comes, but the producer has not said so.
    with pytest.raises(TimeoutError):
        drain(12)
    assert entries_taken(spark, checkpoint) == 1
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        producer.finish()
    late = threading.Timer(1.5, lambda: (producer.send(numbers(spark, 5, 10), 1), producer.finish()))
    late.start()
    assert sorted(r.n for r in drain(60).collect()) == list(range(15))
    late.join()
    # Sent again, and drained again: nothing twice.
    producer.send(numbers(spark, 5, 10), 1)
    assert drain(60).count() == 15 and entries_taken(spark, checkpoint) == 3


def test_a_topic_that_is_finished_and_empty(spark):
    topic = FolderTopic(new_path(spark, "topic"), numbers(spark, 0, 1).schema)
    FolderProducer(spark, topic.path).finish()
    assert drain_until_finished(spark, topic, patience=30).count() == 0


def test_columns_that_a_file_lacks_are_null(spark):
    schema = "n long, name string, at timestamp"
    topic = FolderTopic(new_path(spark, "topic"), spark.createDataFrame([], schema).schema)
    producer = FolderProducer(spark, topic.path)
    producer.send(spark.sql("SELECT 1L AS n, timestamp'2024-01-02 03:04:05' AS at, 'extra' AS other"))
    producer.send(spark.sql("SELECT 2 AS n, 'b' AS name"))
    producer.finish()
    found = drain_until_finished(spark, topic, lambda s: s.selectExpr("n", "name", "CAST(at AS STRING) AS at"), patience=30)
    assert sorted(map(tuple, found.collect())) == [(1, None, "2024-01-02 03:04:05"), (2, "b", None)]


# ---- delivery once

FAILING = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[1])
from tableloom.sinks.ledger import deliver_once
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[2]).getOrCreate()

def fails_late(batches):
    sent = 0
    for batch in batches:
        yield batch
        sent += batch.num_rows
        if sent >= 2000 and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost after sending")

spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
deliver_once(spark.range(0, 10000, 1, 4).mapInArrow(fails_late, "id long"), sys.argv[2] + "/out", "job", 300)
"""


def test_a_task_that_fails_after_sending(spark, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", FAILING, root, str(tmp_path)], check=True, timeout=240)
    path = str(tmp_path / "out")
    assert len(os.listdir(tmp_path / "out" / "batches")) > 4  # the failed attempts' files are there
    rows = read_delivered(spark, path, spark.range(1).schema)
    assert Counter(r.id for r in rows.collect()) == Counter(range(10000))
    sizes = [r["count"] for r in rows.groupBy("delivery", "part", "batch_no").count().collect()]
    assert sorted(sizes) == [100] * 4 + [300] * 32
    assert [tuple(r)[0::3] for r in read_ledger(spark, path).orderBy("part").collect()] == [("job", 9)] * 4


def test_deliveries_by_name(spark):
    path = new_path(spark, "delivered")
    rows = spark.range(0, 10, 1, 2)
    deliver_once(rows, path, "a", 3)
    deliver_once(rows.selectExpr("id + 100 AS id"), path, "a", 3)  # that name is taken
    deliver_once(rows.limit(0), path, "empty", 3)
    deliver_once(rows, path, "b", 30)
    assert Counter((r.id, r.delivery) for r in read_delivered(spark, path, rows.schema).collect()) == Counter(
        (i, d) for i in range(10) for d in "ab"
    )
    for bad in (dict(delivery="x/y", size=3), dict(delivery="x", size=0)):
        with pytest.raises(ValueError):
            deliver_once(rows, path, **bad)
    with pytest.raises(ValueError):
        deliver_once(rows.withColumnRenamed("id", "part"), path, "c", 3)


# ---- joins that go on


def growing(spark, name, schema):
    path = new_path(spark, name)
    spark.createDataFrame([], "value string").write.parquet(path)
    empty = spark.createDataFrame([], schema)

    def add(rows, raw=()):
        df = spark.createDataFrame(rows, schema)
        messages = df.select(encode_positional(df.columns).alias("value"))
        messages = messages.unionAll(spark.createDataFrame([(r,) for r in raw], "value string"))
        messages.write.mode("append").parquet(path)

    return add, lambda keep=False: Topic(file_stream(spark, path, "value string"), export_schema(empty), keep)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", ["inner", "left_outer", "right", "full"])
def test_steps_add_up_to_the_whole_join(spark, how):
    steps = [
        ([(1, "a"), (2, "b"), (None, "n")], [(1, 10), (3, 30)]),
        ([], [(2, 20), (1, 11)]),
        ([(3, "c"), (1, "a"), (9, "z")], []),
        ([(4, "d")], [(4, 40), (None, 0), (8, 80)]),
    ]
    add_left, left = growing(spark, "left", "k long, name string")
    add_right, right = growing(spark, "right", "k long, v long")
    path, config = new_path(spark, "state"), JoinConfig("k", "k", how)
    all_left, all_right = [], []
    for new_left, new_right in steps:
        add_left(new_left)
        add_right(new_right)
        all_left, all_right = all_left + new_left, all_right + new_right
        join = ContinuedJoin(spark, path, config)  # a new process knows the state by its path
        join.advance(left(), right())
        l = spark.createDataFrame(all_left, "k long, name string")
        r = spark.createDataFrame(all_right or [(None, None)], "k2 long, v long").where("true" if all_right else "false")
        assert rows_of(join.result(left(), right())) == rows_of(l.join(r, F.col("k") == F.col("k2"), how))
    assert join.steps() == 4


def test_a_step_that_fails_starts_again(spark):
    add_left, left = growing(spark, "left", "k long, name string")
    add_right, right = growing(spark, "right", "k long, v long")
    join = ContinuedJoin(spark, new_path(spark, "state"), JoinConfig("k", "k"))
    with pytest.raises(ValueError):
        join.result(left(), right())
    add_left([(1, "a")], raw=['["x", "bad"]'])
    add_right([(1, 10)])
    with pytest.raises(ValueError):
        join.advance(left(), right())
    assert join.steps() == 0
    add_left([(1, "b")])
    assert rows_of(join.advance(left(True), right())) == Counter([(1, "a", 1, 10), (1, "b", 1, 10)])
    assert [r.decode_errors for r in join.rejects("left", left()).collect()] == ["K"]
    assert rows_of(join.advance(left(True), right())) == Counter()
    assert join.result(left(), right()).count() == 2
    with pytest.raises(ValueError):
        ContinuedJoin(spark, "x", JoinConfig("k", "k", "left_semi"))
