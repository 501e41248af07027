import pytest
from pyspark.sql import functions as F

from tableloom.functions.decode import decode_positional, encode_positional, split_rejects
from tableloom.functions.schema import import_schema
from tableloom.plans.configured_join import JoinConfig, Topic, join_topics
from tableloom.plans.federated import Source, read_source
from tableloom.sources.topics import KafkaTopic
from tableloom.staging import new_path
from tableloom.streaming.drain import Drain, drain, drain_all, file_stream
from tableloom.streaming.publish import copy_files, copy_topic, running_result

ROWS = {"ID": {"type": "LongType()", "order": 1}, "NAME": {"type": "StringType()", "order": 2}}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def topic(spark, data):
    """A folder standing in for a topic: JSON-array messages in Parquet."""
    path = new_path(spark, "topic")
    df = spark.createDataFrame(data, "id string, name string")
    df.select(encode_positional(["id", "name"]).alias("value")).write.parquet(path)
    return path


def test_drain_goes_on_from_its_checkpoint(spark):
    path = topic(spark, [("1", "a"), ("2", "b")])
    out, checkpoint = new_path(spark, "out"), new_path(spark, "cp")
    specs = import_schema(ROWS)
    decode = lambda s: decode_positional(s, specs)
    run = lambda: drain(file_stream(spark, path, "value string"), decode, out, checkpoint)
    assert rows(split_rejects(run())[0]) == [(1, "a"), (2, "b")]
    assert run().count() == 2
    more = spark.createDataFrame([("3", "c"), ("x", "d")], "id string, name string")
    more.select(encode_positional(["id", "name"]).alias("value")).write.mode("append").parquet(path)
    good, rejects = split_rejects(run())
    assert rows(good) == [(1, "a"), (2, "b"), (3, "c")]
    assert [r.decode_errors for r in rejects.collect()] == ["ID"]


def test_a_failed_drain_fails_the_call(spark):
    good = file_stream(spark, topic(spark, [("1", "a")]), "value string")
    bad = good.select(F.raise_error(F.lit("broken")).cast("string").alias("value"))
    with pytest.raises(Exception, match="broken"):
        drain_all([Drain(good), Drain(bad)])


def test_join_of_topics(spark):
    left = lambda keep=False: Topic(
        file_stream(spark, topic(spark, [("1", "a"), ("2", "b"), ("bad", "c")]), "value string"), ROWS, keep)
    right = Topic(file_stream(spark, topic(spark, [("2", "x"), ("2", "y"), ("3", "z")]), "value string"), ROWS)
    with pytest.raises(ValueError):
        join_topics(left(), right, JoinConfig("ID", "ID"))
    joined = join_topics(left(keep=True), right, JoinConfig("ID", "ID", "full"))
    assert joined.columns == ["ID_1", "NAME_1", "ID", "NAME"]
    assert sorted(map(str, (tuple(r) for r in joined.collect()))) == [
        "(1, 'a', None, None)", "(2, 'b', 2, 'x')", "(2, 'b', 2, 'y')", "(None, None, 3, 'z')"]


def test_stream_source_reports_rejects(spark):
    path = topic(spark, [("1", "a"), ("bad", "c")])
    stream = lambda: file_stream(spark, path, "value string")
    with pytest.raises(ValueError):
        read_source(spark, Source("stream", stream(), ROWS))
    assert rows(read_source(spark, Source("stream", stream(), ROWS, ignore_rejects=True))) == [(1, "a")]
    assert read_source(spark, Source("stream", stream())).columns == ["value"]


def test_copy(spark):
    path, sink, checkpoint = topic(spark, [("1", "a")]), new_path(spark, "sink"), new_path(spark, "cp")
    for _ in range(2):
        copy_files(file_stream(spark, path, "value string"), path, sink, checkpoint)
    assert spark.read.parquet(sink).count() == 1
    with pytest.raises(ValueError):
        copy_files(file_stream(spark, path, "value string"), path, path + "/", checkpoint)
    same = KafkaTopic("h:9092", "t")
    with pytest.raises(ValueError):
        copy_topic(spark, same, same, checkpoint)


def test_running_count_over_several_batches(spark):
    path = new_path(spark, "many")
    spark.range(100, numPartitions=5).write.parquet(path)
    stream = file_stream(spark, path, "id long", maxFilesPerTrigger="1")
    counts = stream.groupBy((F.col("id") % 2).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(running_result(counts)) == [(0, 50), (1, 50)]


def test_csv_stream(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"prob{i}.csv").write_text(f"CUST_ID,OUTBUFFER__1\nc{i},0.{i}\nd{i},1.{i}\n")
    stream = file_stream(spark, f"{tmp_path}/prob*.csv", "CUST_ID string, OUTBUFFER__1 string", "csv", header="true", sep=",")
    total = stream.agg(F.count("CUST_ID").alias("n"))
    assert rows(running_result(total)) == [(6,)]


def test_rejects_are_returned_and_counted(spark, tmp_path):
    from tableloom.plans.configured_join import run_join
    from tableloom.sinks.files import FileTarget

    bad = topic(spark, [("1", "a"), ("bad", "c")])
    stream = lambda: file_stream(spark, bad, "value string")
    other = Topic(file_stream(spark, topic(spark, [("1", "x")]), "value string"), ROWS)
    rejects = []
    joined = join_topics(Topic(stream(), ROWS, True), other, JoinConfig("ID", "ID"), rejects)
    assert joined.count() == 1 and [r.decode_errors for r in rejects[0].collect()] == ["ID"]
    source = Source("stream", stream(), ROWS, ignore_rejects=True)
    right = Source("frame", spark.createDataFrame([(1,)], "key long"))
    report = run_join(spark, source, right, JoinConfig("ID", "key"), FileTarget(str(tmp_path / "out"), "parquet"))
    assert (report.read, report.written, report.errors) == (2, 1, 1)


def test_each_cell_is_typed_once(spark):
    specs = import_schema({"ID": {"type": "LongType()", "order": 1}, "DAY": {"type": "DateType()", "order": 2, "date_format": "yyyy"}})
    df = spark.createDataFrame([('["1","2000"]',)], "value string")
    good, _ = split_rejects(decode_positional(df, specs))
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert sum("try_to_timestamp" in line or "gettimestamp" in line for line in plan.splitlines()) == 1
