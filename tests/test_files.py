import glob
import os

import pytest
from pyspark.sql import functions as F

from tableloom.plans.configured_join import JoinConfig, run_join
from tableloom.plans.federated import Source, federated_sql, read_source, run_sql
from tableloom.sinks import topics as topic_sink
from tableloom.sinks.files import FileTarget, write_files, write_single_csv
from tableloom.sinks.report import write_with_report
from tableloom.sinks.tables import TableTarget, create_text_table, write_table
from tableloom.sources.first_lines import first_lines, with_places
from tableloom.sources.files import CsvJob, read_csv, read_csv_job, read_keyed_rows, run_csv_job, split_text
from tableloom.sources.jdbc import JdbcSource, Split
from tableloom.sources.topics import KafkaTopic
from tableloom.staging import new_path, stage, work_root


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [(1, "a,b", 1.5), (2, 'say "x"', -2.0), (3, None, None), (4, "line", 1e-9)], "id int, name string, n double"
    )


def test_csv_round_trip_with_quotes(spark, people, tmp_path):
    path = str(tmp_path / "out")
    write_files(people, FileTarget(path))
    assert rows(read_csv(spark, path, people.schema)) == rows(people)
    assert read_csv(spark, path).dtypes == people.dtypes


def test_bad_rows(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("id,n\n1,2\nx,3\n4,5\n")
    schema = "id int, n int"
    assert rows(read_csv(spark, str(path), schema)) == [(1, 2), (4, 5), (None, 3)]
    assert rows(read_csv(spark, str(path), schema, bad_rows="drop")) == [(1, 2), (4, 5)]
    # Selecting only the good column must not bring the bad row back.
    assert rows(read_csv(spark, str(path), schema, bad_rows="drop").select("n")) == [(2,), (5,)]
    with pytest.raises(Exception):
        read_csv(spark, str(path), schema, bad_rows="fail").collect()
    kept = read_csv(spark, str(path), schema + ", _corrupt_record string")
    assert rows(kept.select("_corrupt_record").where("_corrupt_record is not null")) == [("x,3",)]


def test_csv_job(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("1;a;x\n2;b;y\n3;c;z\n4;d;z\n")
    job = CsvJob(
        str(path), "k int, v string, w string", ";", has_header=False, columns_to_select=["k", "w"], headers=["K", "W"],
        filter_expression="W <> 'x'", start_offset=1, end_offset=3, order_by=["K"],
    )
    assert rows(read_csv_job(spark, job)) == [(3, "z"), (4, "z")]
    assert read_csv_job(spark, CsvJob(str(path), "k int, v string, w string", ";", False, max_read_lines=2)).count() == 2
    with pytest.raises(ValueError):
        read_csv_job(spark, CsvJob(str(path), "k int, v string, w string", ";", False, start_offset=1))


def test_read_lines_are_the_first_of_the_files(spark, tmp_path):
    """Many blocks, bad rows, a filter and few columns: the lines are those a plain reader finds first."""
    lines = []
    for number in range(3):
        mine = [f"{(i * 7919) % 1000},{'x' if i % 50 == 9 else i},{number}" for i in range(400)]
        (tmp_path / f"part-{number}.csv").write_text("\n".join(["k,n,f", *mine]) + "\n")
        lines += [tuple(m.split(",")) for m in mine]
    good = [(int(k), int(f)) for k, n, f in lines if n != "x" and int(k) % 3]
    block = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for n in (1, 77, 300, 555, len(good) - 1, len(good), len(good) + 5):
            job = CsvJob(
                str(tmp_path), "k int, n int, f int", ignore_and_continue=True, columns_to_select=["k", "f"], headers=["K", "F"],
                filter_expression="K % 3 <> 0", max_read_lines=n,
            )
            found = read_csv_job(spark, job)
            assert found.columns == ["K", "F"] and sorted(map(tuple, found.collect())) == sorted(good[:n])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "rangepartitioning" not in plan
        assert read_csv_job(spark, CsvJob(str(tmp_path), "k int, n int, f int", max_read_lines=0)).count() == 0
        # Blocks that changed between the passes stop the job.
        placed = with_places(spark.read.option("header", True).csv(str(tmp_path)))
        late = first_lines(placed, 500)
        moved = placed.withColumn("__block", F.col("__block") + 1)
        assert late.count() == 500
        with pytest.raises(Exception, match="have changed"):
            first_lines(_moving(placed, moved), 500).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)


class _moving:
    """A table whose blocks are others in the second pass."""

    def __init__(self, first, second):
        self.groupBy, self.where, self.drop = first.groupBy, second.where, second.drop


def test_read_lines_are_the_first_in_order(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("3;c\n1;a\n2;b\n")
    job = lambda n, **more: rows(read_csv_job(spark, CsvJob(str(path), "k int, v string", ";", False, max_read_lines=n, **more)))
    assert job(2) == [(1, "a"), (3, "c")] and job(0) == []
    assert job(1, order_by=["v"]) == [(1, "a")]


def test_skipped_lines_are_counted(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("id,n\n1,2\nx,3\n4,5\n")
    job = CsvJob(str(path), "id int, n int", ignore_and_continue=True, calculate_column_size=True, populate_meta_schema=True)
    done = run_csv_job(spark, job)
    assert rows(done.rows) == [(1, 2), (4, 5)] and done.skipped == 1
    assert rows(done.column_sizes) == [("id", 1), ("n", 1)] and list(done.meta_schema) == ["ID", "N"]
    with pytest.raises(Exception):
        read_csv_job(spark, CsvJob(str(path), "id int, n int")).collect()


def test_delimited_text(spark):
    df = spark.createDataFrame([(1, 'a,"b, c",3'), (2, "x,,oops"), (3, None)], "k int, t string")
    assert rows(split_text(df, "t", "p string, q string, r int", keep=["k"])) == [
        (1, "a", "b, c", 3), (2, "x", None, None), (3, None, None, None)]


def test_a_table_does_not_replace_foreign_files(spark, people):
    where = new_path(spark, "foreign")
    people.write.parquet(where)
    with pytest.raises(FileExistsError):
        write_table(people.limit(2), TableTarget("people_x", location=where, overwrite=False))
    assert spark.read.parquet(where).count() == 4
    for name in ("people_y", "people_z"):
        target = TableTarget(name, location=new_path(spark, name), overwrite=False)
        write_table(people, target)
        assert write_table(people, target).count() == 8
        spark.sql(f"DROP TABLE {name}")


def test_partitions_of_a_table_are_few_files(spark):
    df = spark.range(1600, numPartitions=8).selectExpr("id", "id % 20 AS p")
    where = new_path(spark, "few")
    write_table(df, TableTarget("few_files", location=where, partition_by=["p"]))
    assert len(glob.glob(where + "/p=*/*.parquet")) <= 40
    spark.sql("DROP TABLE few_files")


def test_a_join_into_a_table(spark, people):
    frame = Source("frame", people)
    report = run_join(spark, frame, frame, JoinConfig("id", "id"), TableTarget("people_joined"))
    assert report.written == 4 and spark.table("people_joined").count() == 4
    spark.sql("DROP TABLE people_joined")


def test_guard_runs_before_the_job(spark, people, tmp_path):
    path = str(tmp_path / "out")
    write_files(people, FileTarget(path, "parquet", overwrite=False))
    broken = people.select(F.raise_error(F.lit("must not run")).alias("x"))
    with pytest.raises(FileExistsError):
        write_files(broken, FileTarget(path, "parquet", overwrite=False))
    for bad in (FileTarget(""), FileTarget(path, "xml"), FileTarget(path, "csv", codec="zstd"), FileTarget(path, delimiter="")):
        with pytest.raises(ValueError):
            write_files(broken, bad)


@pytest.mark.parametrize(
    "format,codec",
    [("csv", "bzip2"), ("csv", "lz4"), ("csv", "deflate"), ("csv", None), ("orc", "zlib"), ("orc", "snappy"),
     ("parquet", "gzip"), ("parquet", "zstd"), ("parquet", "none")],
)
def test_formats(spark, people, tmp_path, format, codec):
    path = str(tmp_path / "out")
    write_files(people, FileTarget(path, format, codec=codec))
    reader = spark.read.format(format).schema(people.schema).option("header", True)
    assert rows(reader.load(path)) == rows(people)


def test_partitioned_layout(spark, tmp_path):
    df = spark.range(600, numPartitions=12).selectExpr("id", "id % 3 AS a", "id % 2 AS b")
    path = str(tmp_path / "out")
    write_files(df, FileTarget(path, "parquet", partition_by=["a", "b"]))
    assert len(glob.glob(path + "/a=*/b=*")) == 6
    assert len(glob.glob(path + "/a=*/b=*/*.parquet")) <= 12
    assert rows(spark.read.schema("id long, a long, b long").parquet(path)) == rows(df)


def test_single_csv(spark, people, tmp_path):
    path = str(tmp_path / "one")
    write_single_csv(people.repartition(3), FileTarget(path))
    (part,) = glob.glob(path + "/*.csv")
    assert open(part).read().count("id,name,n") == 1


def test_report(spark, tmp_path):
    df = spark.range(1000, numPartitions=4).select("id", F.when(F.col("id") % 10 != 0, F.col("id")).alias("v"))
    path = str(tmp_path / "out")
    report = write_with_report(
        df, lambda d: d.write.parquet(path), ignore=F.col("v") > 500, error=F.col("id") >= 900
    )
    # v is NULL on every tenth row: neither true nor false, so the row is written.
    ignored = sum(1 for i in range(900) if i % 10 and i > 500)
    assert (report.read, report.errors, report.ignored) == (1000, 100, ignored)
    assert report.written == spark.read.parquet(path).count() == 900 - ignored
    assert list(report.schema) == ["ID", "V"]


def test_tables(spark, people):
    managed = write_table(people, TableTarget("people_t", partition_by=["id"], codec="zstd"))
    assert rows(managed.select("id", "name", "n")) == rows(people)
    more = people.select("n", "id", "name").where("id = 1")
    assert write_table(more, TableTarget("people_t", overwrite=False)).where("id = 1").count() == 2
    replaced = write_table(people.where("id = 1"), TableTarget("people_u"))
    assert write_table(people, TableTarget("people_u", truncate=True)).count() == 4
    assert replaced.columns == people.columns
    assert write_table(people.select("id"), TableTarget("people_u", drop=True)).columns == ["id"]
    where = new_path(spark, "external")
    write_table(people, TableTarget("people_e", "csv", location=where, field_delimiter="|"))
    assert "|" in open(glob.glob(where + "/*.csv")[0]).read()
    text = create_text_table(spark, "people_text", "id INT, name STRING, n DOUBLE", where, "|")
    assert rows(text) == rows(people)
    assert rows(read_source(spark, Source("table", "people_text"))) == rows(people)
    with pytest.raises(ValueError):
        write_table(people, TableTarget("bad name; drop"))
    for name in ("people_t", "people_u", "people_e", "people_text"):
        spark.sql(f"DROP TABLE {name}")


def test_batches_per_task(spark, tmp_path):
    folder = str(tmp_path)

    def send(partition, batch):
        with open(os.path.join(folder, f"{partition}-{batch[0].id}"), "w") as out:
            out.write(",".join(str(r.id) for r in batch))

    topic_sink.deliver(spark.range(50, numPartitions=3), 7, send)
    sent = [open(p).read().split(",") for p in glob.glob(folder + "/*")]
    assert sorted(int(v) for batch in sent for v in batch) == list(range(50))
    assert max(len(batch) for batch in sent) == 7


def test_keyed_publish(spark, tmp_path):
    folder = str(tmp_path)

    def send(batches):
        for b in batches:
            with open(os.path.join(folder, f"{b.k}-{b.batch_no}"), "w") as out:
                out.write("\n".join(b["items"]))

    df = spark.range(30).selectExpr("concat('k', id % 2) AS k", "id")
    topic_sink.publish_batches(df, "k", ["id"], 4, send)
    assert open(folder + "/k1-3").read().split("\n") == ['["k1","25"]', '["k1","27"]', '["k1","29"]']
    assert len(os.listdir(folder)) == 8
    assert topic_sink.to_messages(df.limit(1)).first().value == '{"k":"k0","id":0}'


def test_topic_options():
    topic = KafkaTopic("h:9092", "t", "latest", {"kafka.batch.size": "5000"})
    assert topic.source_options() == {
        "kafka.bootstrap.servers": "h:9092", "kafka.batch.size": "5000", "subscribe": "t", "startingOffsets": "latest"}
    assert topic.sink_options() == {"kafka.bootstrap.servers": "h:9092", "kafka.batch.size": "5000", "topic": "t"}
    for bad in (KafkaTopic("", "t"), KafkaTopic("h", ""), KafkaTopic("h", "t", "middle")):
        with pytest.raises(ValueError):
            bad.source_options()


def test_jdbc_options():
    plain = JdbcSource("jdbc:x", query="SELECT 1", user="u", fetch_size=1_000_000, session_init="ALTER SESSION")
    assert plain.options() == {
        "url": "jdbc:x", "fetchsize": "1000000", "user": "u", "sessionInitStatement": "ALTER SESSION", "query": "SELECT 1"}
    split = JdbcSource("jdbc:x", query="SELECT 1", split=Split("d", "2010-01-01", "2016-12-31"))
    assert split.options() == {
        "url": "jdbc:x", "fetchsize": "10000", "dbtable": "(SELECT 1) source_query", "partitionColumn": "d",
        "lowerBound": "2010-01-01", "upperBound": "2016-12-31", "numPartitions": "10"}
    for bad in (JdbcSource("u"), JdbcSource("u", "t", "q"), JdbcSource("u", "t", split=Split("c", "0", "1", 0))):
        with pytest.raises(ValueError):
            bad.options()


def test_keyed_rows(spark):
    path = new_path(spark, "keyed")
    df = spark.createDataFrame([("k", ["a", "b"])], "key string, content array<string>")
    df.write.parquet(path)
    assert rows(read_keyed_rows(spark, path, "parquet")) == rows(df)


def test_sources_of_different_kinds(spark, people, tmp_path):
    csv, parquet = str(tmp_path / "c"), str(tmp_path / "p")
    write_files(people, FileTarget(csv))
    write_files(people, FileTarget(parquet, "parquet"))
    got = federated_sql(
        spark, Source("csv", csv, people.schema), Source("parquet", parquet),
        "SELECT * FROM left JOIN right ON left.id = right.id WHERE left.n > 0",
    )
    assert got.columns == ["id_1", "name_1", "n_1", "id", "name", "n"] and got.count() == 2
    with pytest.raises(ValueError):
        read_source(spark, Source("ftp", "x"))
    target = FileTarget(str(tmp_path / "o"), "orc")
    query = "SELECT l.id, r.name FROM left l JOIN right r ON l.id = r.id"
    report = run_sql(spark, Source("csv", csv, people.schema), Source("parquet", parquet), query, target)
    assert report.written == 4 and spark.read.orc(target.path).count() == 4


def test_job_options():
    target = FileTarget.from_options({"filePath": "p", "delimiter": None, "other": 1})
    assert (target.path, target.delimiter, target.overwrite) == ("p", ",", True)
    assert FileTarget.from_options({"filePath": "p", "overwrite": False}).overwrite is False
    with pytest.raises(ValueError):
        FileTarget.from_options({"filePath": None}).check()
    table = TableTarget.from_options(
        {"table_name": "t", "table_location": "/x", "external": True, "format": "", "partition_col": "", "compression": ""}
    )
    assert table == TableTarget("t", location="/x")
    job = CsvJob.from_options({"path": "p", "maxReadLines": 5, "columnsToSelect": ["a"], "headers": ["A"], "filterExpression": ""}, "a int")
    assert job == CsvJob("p", columns_to_select=["a"], headers=["A"], max_read_lines=5)
    assert CsvJob.from_options({"path": "p.csv", "fileInZip": "only if the path is an archive"}) == CsvJob("p.csv")
    with pytest.raises(ValueError):
        CsvJob.from_options({"path": "p.zip", "fileInZip": "x.csv"})
    assert JoinConfig.from_options({"unique_key_left": "a", "unique_key_right": "b", "join_type": "left"}).join_type == "left"
    with pytest.raises(ValueError):
        JoinConfig.from_options({"unique_key_left": "a"})


def test_join_run_writes_and_reports(spark, people, tmp_path):
    target = FileTarget(str(tmp_path / "out"), "parquet", overwrite=False)
    frame = Source("frame", people)
    report = run_join(spark, frame, frame, JoinConfig("id", "id", "full"), target)
    assert report.written == 4
    assert spark.read.parquet(target.path).columns == ["id_1", "name_1", "n_1", "id", "name", "n"]
    with pytest.raises(FileExistsError):
        run_join(spark, frame, frame, JoinConfig("id", "id"), target)


def test_work_folder_follows_the_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert work_root(spark).startswith(base) and os.path.isdir(work_root(spark))
    assert rows(stage(spark.range(3))) == [(0,), (1,), (2,)]
