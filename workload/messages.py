"""Files, messages, streams and writers, each read back after writing."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.decode import (
    decode_positional as decode,
    encode_positional,
    pad_ragged,
    split_rejects,
)
from tableloom.functions.schema import export_schema, import_schema
from tableloom.plans.configured_join import JoinConfig, Topic, join_topics, run_join
from tableloom.plans.continued_join import ContinuedJoin
from tableloom.plans.federated import Source, federated_sql
from tableloom.sinks.files import FileTarget, write_files
from tableloom.sinks.folder_topic import FolderProducer
from tableloom.sinks.ledger import deliver_once, deliver_stream, read_delivered
from tableloom.sinks.report import write_with_report
from tableloom.sinks.tables import TableTarget, write_table
from tableloom.sinks.topics import keyed_batches as batches
from tableloom.sources.files import CsvJob, read_csv, read_csv_job, run_csv_job, split_text
from tableloom.sources.folder_topic import FolderTopic
from tableloom.staging import new_path, stage
from tableloom.streaming.drain import drain, drain_until_finished as drain_to_the_end, file_stream
from tableloom.streaming.publish import copy_files, encode_stream, running_result
from workload.registry import query, table

_PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def _csv(df: DataFrame, label: str, **options) -> str:
    path = new_path(df.sparkSession, label)
    write_files(df, FileTarget(path, **options))
    return path


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # A stream reads folders and patterns; the pattern also fits a folder of part files.
    return file_stream(spark, f"{sf}/{name}.parquet*", table(spark, sf, name).schema)


def _message_stream(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, dict]:
    stream = _stream(spark, sf, name)
    return stream.select(encode_positional(stream.columns).alias("value")), export_schema(stream)


def _none(rejects: DataFrame) -> None:
    if not rejects.isEmpty():
        raise ValueError("messages were rejected")


# ---- CSV


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    return read_csv(spark, _csv(table(spark, sf, "customer"), "customer"))


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_with_schema(spark: SparkSession, sf: str) -> DataFrame:
    path = _csv(table(spark, sf, "part"), "part", delimiter=";", codec="gzip")
    return read_csv(spark, path, _PART, delimiter=";")


@query(
    """SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS price
       FROM orders WHERE o_totalprice > 250000 AND o_orderstatus <> 'P'"""
)
def csv_source_options(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )
    job = CsvJob(
        _csv(orders, "orders"),
        schema=orders.schema,
        columns_to_select=["o_orderkey", "o_orderstatus", "o_totalprice"],
        headers=["order_id", "status", "price"],
        filter_expression="price > 250000 AND status <> 'P'",
    )
    return read_csv_job(spark, job)


@query(
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey
       LIMIT 300 OFFSET 200"""
)
def csv_source_slice(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    job = CsvJob(
        _csv(orders, "orders"),
        schema=orders.schema,
        start_offset=200,
        end_offset=500,
        order_by=["o_totalprice", "o_orderkey"],
    )
    return read_csv_job(spark, job)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def csv_bad_rows_dropped(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(
        F.col("o_totalprice").cast("string")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", price.alias("o_totalprice"))
    job = CsvJob(
        _csv(orders, "orders"), schema="o_orderkey long, o_totalprice double", ignore_and_continue=True
    )
    return read_csv_job(spark, job)


# ---- messages


_LINE = {
    "L_ORDERKEY": {"type": "LongType()", "order": 1},
    "L_LINENUMBER": {"type": "IntegerType()", "order": 2},
    "L_QUANTITY": {"type": "IntegerType()", "order": 3},
    "L_EXTENDEDPRICE": {"type": "DoubleType()", "order": 4},
    "L_DISCOUNT": {"type": "FloatType()", "order": 5},
    "L_COMMENT": {"type": "StringType()", "order": 6, "active": False},
    "L_SHIPDATE": {"type": "TimestampNTZType()", "order": 7, "date_format": "yyyy-MM-dd HH:mm:ss"},
}


@query(
    """SELECT l_orderkey AS L_ORDERKEY, l_linenumber AS L_LINENUMBER,
              CAST(trunc(l_quantity) AS INTEGER) AS L_QUANTITY, l_extendedprice AS L_EXTENDEDPRICE,
              CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS L_DISCOUNT, l_shipdate AS L_SHIPDATE FROM lineitem"""
)
def decode_positional(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    cells = [
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        F.lit("unused"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"),
    ]
    messages = lines.select(encode_positional(cells).alias("value"))
    rows = stage(decode(messages, import_schema(_LINE)), "decoded")
    good, rejects = split_rejects(rows)
    _none(rejects)
    return good.withColumn("L_DISCOUNT", F.col("L_DISCOUNT").cast("double"))


@query(
    """SELECT l_linenumber, errors, count(*) AS n FROM (
         SELECT l_linenumber, CASE WHEN l_linenumber = 5 THEN 'value'
                     WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'PRICE,DAY'
                     WHEN l_returnflag = 'R' THEN 'PRICE'
                     WHEN l_linestatus = 'F' THEN 'DAY' END AS errors FROM lineitem)
       WHERE errors IS NOT NULL GROUP BY ALL"""
)
def decode_rejects(spark: SparkSession, sf: str) -> DataFrame:
    specs = import_schema(
        {
            "LINE": {"type": "LongType()", "order": 1},
            "PRICE": {"type": "DoubleType()", "order": 2},
            "DAY": {"type": "DateType()", "order": 3},
        }
    )
    price = F.expr("if(l_returnflag = 'R', 'n/a', cast(l_extendedprice AS string))")
    day = F.expr("if(l_linestatus = 'F', 'never', cast(cast(l_shipdate AS date) AS string))")
    message = encode_positional(["l_linenumber", price, day])
    messages = table(spark, sf, "lineitem").select(
        "l_linenumber", F.when(F.col("l_linenumber") == 5, F.lit("{cut off")).otherwise(message).alias("value")
    )
    _, rejects = split_rejects(decode(messages, specs, keep=["l_linenumber"]))
    return rejects.groupBy("l_linenumber", F.col("decode_errors").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS ID,
              CASE WHEN p_partkey % 5 >= 1 THEN p_name ELSE '' END AS NAME,
              CASE WHEN p_partkey % 5 >= 3 THEN p_type ELSE '' END AS TYPE,
              CASE WHEN p_partkey % 5 >= 4 THEN CAST(p_size AS VARCHAR) ELSE '' END AS SIZE FROM part"""
)
def ragged_pad(spark: SparkSession, sf: str) -> DataFrame:
    specs = import_schema(
        {
            "ID": {"type": "StringType()", "order": 1},
            "NAME": {"type": "StringType()", "order": 2, "active": True},
            "BRAND": {"type": "StringType()", "order": 3, "active": False},
            "TYPE": {"type": "StringType()", "order": 4},
            "SIZE": {"type": "StringType()", "order": 5},
        }
    )
    full = F.array(*[F.col(c).cast("string") for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size")])
    cut = F.slice(full, F.lit(1), (F.col("p_partkey") % 5 + 1).cast("int"))
    ragged = table(spark, sf, "part").select("p_partkey", cut.alias("cells"))
    return pad_ragged(ragged, specs, "cells", keep=["p_partkey"])


@query(
    """SELECT o_orderpriority, batch_no, count(*) AS n, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order
       FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 250 AS batch_no
             FROM orders) GROUP BY ALL"""
)
def keyed_batches(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    sent = batches(orders, "o_orderpriority", ["o_orderkey"], 250, unique=True)

    def order_of(message):
        return F.get(F.from_json(message, "array<string>"), F.lit(0)).cast("long")

    return sent.select(
        "o_orderpriority",
        "batch_no",
        "n",
        order_of(F.element_at("items", 1)).alias("first_order"),
        order_of(F.element_at("items", -1)).alias("last_order"),
    )


# ---- streams


@query(
    """SELECT event_id AS EVENT_ID, ts AS TS, user_id AS USER_ID, event_type AS EVENT_TYPE,
              value AS VALUE, props AS PROPS FROM events"""
)
def bounded_drain(spark: SparkSession, sf: str) -> DataFrame:
    stream, descriptor = _message_stream(spark, sf, "events")
    specs = import_schema(descriptor)
    good, rejects = split_rejects(drain(stream, lambda s: decode(s, specs)))
    _none(rejects)
    return good


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_directory_stream(spark: SparkSession, sf: str) -> DataFrame:
    path = _csv(table(spark, sf, "part"), "part")
    return drain(file_stream(spark, path, _PART, "csv", header="true"))


@query("SELECT count(event_id) AS n FROM events")
def stream_count(spark: SparkSession, sf: str) -> DataFrame:
    return running_result(_stream(spark, sf, "events").agg(F.count("event_id").alias("n")))


@query("SELECT CAST(user_id AS VARCHAR) AS key, event_id, event_type, value FROM events")
def stream_encode(spark: SparkSession, sf: str) -> DataFrame:
    events = _stream(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    sent = drain(encode_stream(events, "user_id"))
    row = F.from_json("value", "event_id long, event_type string, value double").alias("row")
    return sent.select("key", row).select("key", "row.*")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_copy(spark: SparkSession, sf: str) -> DataFrame:
    stream = _stream(spark, sf, "events").select("event_id", "user_id", "event_type")
    sink, checkpoint = new_path(spark, "copy"), new_path(spark, "checkpoint")
    copy_files(stream, sf, sink, checkpoint)
    # The second run goes on from the checkpoint and finds nothing new.
    copy_files(stream, sf, sink, checkpoint)
    return spark.read.schema(stream.schema).parquet(sink)


@query(
    """SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME, c_mktsegment AS C_MKTSEGMENT,
              o_orderkey AS O_ORDERKEY, o_totalprice AS O_TOTALPRICE
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey"""
)
def join_drained_topics(spark: SparkSession, sf: str) -> DataFrame:
    left = Topic(*_message_stream(spark, sf, "customer"))
    right = Topic(*_message_stream(spark, sf, "orders"))
    joined = join_topics(left, right, JoinConfig("C_CUSTKEY", "O_CUSTKEY", "left"))
    return joined.select("C_CUSTKEY", "C_NAME", "C_MKTSEGMENT", "O_ORDERKEY", "O_TOTALPRICE")


@query(
    """SELECT c_mktsegment AS segment, count(*) AS orders,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
       FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"""
)
def federated_sql_join(spark: SparkSession, sf: str) -> DataFrame:
    stream, descriptor = _message_stream(spark, sf, "orders")
    return federated_sql(
        spark,
        Source("parquet", f"{sf}/customer.parquet"),
        Source("stream", stream, descriptor),
        """SELECT l.c_mktsegment AS segment, count(*) AS orders,
                  CAST(sum(CAST(r.o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
           FROM left l JOIN right r ON l.c_custkey = r.o_custkey GROUP BY l.c_mktsegment""",
    )


# ---- writers


@query("SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders")
def write_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    path = new_path(spark, "partitioned")
    write_files(orders, FileTarget(path, "parquet", partition_by=["o_orderpriority", "o_orderstatus"]))
    return spark.read.schema(orders.schema).parquet(path)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")
def write_append(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = new_path(spark, "appended")
    write_files(customers, FileTarget(path, "parquet", codec="zstd", overwrite=False))
    write_files(customers, FileTarget(path, "parquet", codec="gzip", append=True))
    return spark.read.schema(customers.schema).parquet(path)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def write_orc(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "orc")
    suppliers = table(spark, sf, "supplier")
    write_files(suppliers, FileTarget(path, "orc", codec="zlib"))
    return spark.read.format("orc").schema(suppliers.schema).load(path)


@query("SELECT p_partkey, p_name, p_size, p_brand FROM part")
def write_catalog_table(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    path = new_path(spark, "parts")
    name = f"parts_{path[-32:]}"
    written = write_table(parts, TableTarget(name, location=path))
    # The plan knows the files by now, and they go with the work folder.
    spark.sql(f"DROP TABLE {name}")
    return written


@query(
    """SELECT count(*) AS rows_read, count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice <= 400000) AS rows_written,
              count(*) FILTER (o_orderstatus = 'P' AND o_totalprice <= 400000) AS rows_ignored,
              count(*) FILTER (o_totalprice > 400000) AS rows_in_error FROM orders"""
)
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    target = FileTarget(new_path(spark, "reported"), "parquet")
    report = write_with_report(
        orders,
        lambda df: write_files(df, target),
        ignore=F.col("o_orderstatus") == "P",
        error=F.col("o_totalprice") > 400000,
    )
    line = [(report.read, report.written, report.ignored, report.errors)]
    return spark.createDataFrame(
        line, "rows_read long, rows_written long, rows_ignored long, rows_in_error long"
    )


@query(
    """SELECT column_name, max_length, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS skipped,
              'LongType(),StringType(),DecimalType(20,1)' AS types FROM (
         SELECT 'order_id' AS column_name, CAST(max(length(CAST(o_orderkey AS VARCHAR))) AS BIGINT) AS max_length
         FROM orders WHERE o_orderstatus <> 'P'
         UNION ALL SELECT 'status', max(length(o_orderstatus)) FROM orders WHERE o_orderstatus <> 'P'
         UNION ALL SELECT 'cents', max(length(CAST(CAST(o_totalprice * 100 AS BIGINT) AS VARCHAR))) + 2
         FROM orders WHERE o_orderstatus <> 'P')"""
)
def job_csv_report(spark: SparkSession, sf: str) -> DataFrame:
    """A job file's read: sizes, schema and the lines that did not fit."""
    cents = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(
        F.concat((F.col("o_totalprice") * 100).cast("long").cast("string"), F.lit(".0"))
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", cents.alias("cents"))
    path = _csv(orders, "orders", delimiter=";")
    options = {
        "path": path,
        "delimiter": ";",
        "headers": ["order_id", "status", "cents"],
        "columnsToSelect": ["o_orderkey", "o_orderstatus", "cents"],
        "fileInZip": "only if the path is an archive",
        "userProvidedSchema": True,
        "ignoreAndContinue": True,
        "calculateColumnSize": True,
        "populateMetaSchema": True,
    }
    done = run_csv_job(spark, CsvJob.from_options(options, "o_orderkey long, o_orderstatus string, cents decimal(20,1)"))
    return done.column_sizes.withColumns(
        {"skipped": F.lit(done.skipped).cast("long"), "types": F.lit(",".join(d["type"] for d in done.meta_schema.values()))}
    )


@query(
    """SELECT c_custkey AS id, c_mktsegment || ', "' || c_name || '"' AS note, CAST(trunc(c_acctbal) AS INTEGER) AS balance,
              NULL::INTEGER AS word FROM customer"""
)
def split_csv_text(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of delimited cells with quotes; the last cell does not fit its type."""
    customers = table(spark, sf, "customer").select(
        "c_custkey",
        F.concat("c_mktsegment", F.lit(', "'), "c_name", F.lit('"')).alias("note"),
        F.col("c_acctbal").cast("int").alias("balance"),
        F.lit("word").alias("word"),
    )
    messages = customers.select(F.to_csv(F.struct("*")).alias("value"))
    return split_text(messages, "value", "id long, note string, balance int, word int")


def _spoiled(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    """Orders as messages, those with status P with a key that is no number."""
    stream = _stream(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    key = F.when(F.col("o_orderstatus") == "P", F.lit("?")).otherwise(F.col("o_orderkey").cast("string"))
    cells = [key, "o_custkey", "o_orderstatus"]
    return stream.select(encode_positional(cells).alias("value")), export_schema(stream)


@query(
    """SELECT 'joined' AS part, c_mktsegment AS name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey
       WHERE o_orderstatus <> 'P' GROUP BY ALL
       UNION ALL SELECT 'rejected', 'O_ORDERKEY', count(*) FROM orders WHERE o_orderstatus = 'P'"""
)
def join_topics_with_rejects(spark: SparkSession, sf: str) -> DataFrame:
    left = Topic(*_message_stream(spark, sf, "customer"))
    right = Topic(*_spoiled(spark, sf), keep_rejects=True)
    rejects: list[DataFrame] = []
    joined = join_topics(left, right, JoinConfig("C_CUSTKEY", "O_CUSTKEY"), rejects)
    (bad,) = rejects
    counts = [
        df.groupBy(F.lit(part).alias("part"), F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        for df, part, name in ((joined, "joined", "C_MKTSEGMENT"), (bad, "rejected", "decode_errors"))
    ]
    return counts[0].unionAll(counts[1])


@query(
    """SELECT count(*) AS rows_read, count(*) FILTER (o_orderstatus <> 'P') AS rows_written, 0::BIGINT AS rows_ignored,
              count(*) FILTER (o_orderstatus = 'P') AS rows_in_error FROM orders"""
)
def run_report_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What a source turns away is in the report of the job; every order has one customer."""
    stream, descriptor = _spoiled(spark, sf)
    report = run_join(
        spark,
        Source("parquet", f"{sf}/customer.parquet"),
        Source("stream", stream, descriptor, ignore_rejects=True),
        JoinConfig("c_custkey", "O_CUSTKEY"),
        FileTarget(new_path(spark, "joined"), "parquet"),
    )
    line = [(report.read, report.written, report.ignored, report.errors)]
    return spark.createDataFrame(line, "rows_read long, rows_written long, rows_ignored long, rows_in_error long")


@query(
    """SELECT c_custkey, c_nationkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def join_to_table(spark: SparkSession, sf: str) -> DataFrame:
    """A configured join into a partitioned table."""
    path = new_path(spark, "joined")
    name = f"joined_{path[-32:]}"
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    target = TableTarget(name, location=path, partition_by=["n_name"], overwrite=False)
    run_join(spark, Source("frame", customers), Source("frame", nations), JoinConfig("c_nationkey", "n_nationkey"), target)
    schema = spark.table(name).schema
    # An external table leaves its files, partitions in folders, to be read.
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(schema).parquet(path)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def drain_until_finished(spark: SparkSession, sf: str) -> DataFrame:
    """Events that are sent while the drain runs, one entry behind its turn."""
    events = table(spark, sf, "events")
    topic = FolderTopic(new_path(spark, "events-topic"), events.schema)
    producer = FolderProducer(spark, topic.path)
    first = producer.reserve(6)

    def produce() -> None:
        for number in (0, 1, 3, 4, 2, 5):
            producer.send(events.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == number), first + number)
        producer.finish()

    with ThreadPoolExecutor(1) as pool:
        sending = pool.submit(produce)
        drained = drain_to_the_end(spark, topic, patience=600)
        sending.result()
    return drained


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice, 'table' AS delivery, true AS fits FROM orders
       UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 'stream', true FROM orders"""
)
def delivered_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A table that is sent twice under one name, and a stream, in batches of 500 rows: each row arrives once."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    stream = _stream(spark, sf, "orders").select(*orders.columns)
    path, checkpoint = new_path(spark, "delivered"), new_path(spark, "checkpoint")
    for _ in range(2):
        deliver_once(orders, path, "table", 500)
        deliver_stream(stream, path, "stream", 500, checkpoint, once=True).awaitTermination()
    rows = read_delivered(spark, path, orders.schema)
    sizes = rows.groupBy("delivery", "part", "batch_no").agg((F.count(F.lit(1)) <= 500).alias("fits"))
    return rows.join(sizes, ["delivery", "part", "batch_no"]).select(*orders.columns, "delivery", "fits")


@query(
    """SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME, o_orderkey AS O_ORDERKEY, o_totalprice AS O_TOTALPRICE
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey"""
)
def join_topics_in_two_drains(spark: SparkSession, sf: str) -> DataFrame:
    """Topics that grow between two steps; matches of new rows with earlier ones are found on both sides."""
    join = ContinuedJoin(spark, new_path(spark, "continued"), JoinConfig("C_CUSTKEY", "O_CUSTKEY", "left"))
    halves, topics = {}, []
    for name, key, columns in (("customer", "c_custkey", ["c_custkey", "c_name"]), ("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_totalprice"])):
        rows = table(spark, sf, name).select(*columns)
        messages = rows.select(encode_positional(columns).alias("value"), F.pmod(F.xxhash64(key), F.lit(2)).alias("half"))
        path = new_path(spark, f"{name}-topic")
        halves[path] = messages
        spark.createDataFrame([], "value string").write.parquet(path)
        topics.append(Topic(file_stream(spark, path, "value string"), export_schema(rows)))
    for half in (0, 1):
        for path, messages in halves.items():
            messages.where(F.col("half") == half).select("value").write.mode("append").parquet(path)
        join.advance(*topics)
    return join.result(*topics).select("C_CUSTKEY", "C_NAME", "O_ORDERKEY", "O_TOTALPRICE")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3000")
def csv_first_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The first 3 000 lines of files in key order, as the files have them."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = new_path(spark, "ordered")
    orders.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", True).csv(path)
    return read_csv_job(spark, CsvJob(path, orders.schema, max_read_lines=3000))
