"""Delivery in batches, each exactly once: tasks prepare files, the driver enters them in a ledger.

Layout below the path: ``batches/`` holds a file for every task attempt, one row group per batch;
``ledger/`` holds an entry for every delivery, naming the file of the attempt that counts for each
partition. An entry appears as a whole when the job commits. Readers take files that the ledger
names, so what a failed, repeated or speculative attempt left is never seen. A delivery that is in
the ledger stays as it is: a stream's batch that runs again after a crash, or a job that is started
again under the same name, delivers nothing more.

Rows carry ``delivery``, ``part`` and ``batch_no``, a key that receivers outside can use to tell repeats.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

# The sink runs in Python workers, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("delivery", "part", "batch_no")
_ENTRY = "delivery string, parts array<struct<part: long, file: string, batches: long, rows: long>>"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


@dataclass
class Prepared(WriterCommitMessage):
    """What one task attempt has ready."""

    part: int
    file: str
    batches: int
    rows: int


def _prepare(path: str, delivery: str, size: int, schema: T.StructType, batches: Iterator) -> Prepared:
    """Write a partition's rows as batches of ``size``; the last one may be smaller."""
    import pyarrow as pa
    from pyarrow import parquet
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    part = TaskContext.get().partitionId()
    wanted = to_arrow_schema(schema)
    for name, kind in zip(KEYS, (pa.string(), pa.int64(), pa.int64())):
        wanted = wanted.append(pa.field(name, kind))
    files, root = _files(path)
    file = f"{part}-{uuid.uuid4().hex}.parquet"
    files.create_dir(f"{root}/batches")
    number = rows = held = 0
    waiting: list = []
    with files.open_output_stream(f"{root}/batches/{file}") as out, parquet.ParquetWriter(out, wanted) as writer:

        def put(table) -> None:
            nonlocal number, rows
            keys = [pa.array([delivery] * table.num_rows), *(pa.array([n] * table.num_rows, pa.int64()) for n in (part, number))]
            writer.write_table(pa.Table.from_arrays([*table.columns, *keys], schema=wanted), row_group_size=max(table.num_rows, 1))
            number, rows = number + 1, rows + table.num_rows

        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held >= size:
                table = pa.Table.from_batches(waiting).combine_chunks()
                for start in range(0, held - held % size, size):
                    put(table.slice(start, size))
                waiting, held = table.slice(held - held % size).to_batches(), held % size
        if held:
            put(pa.Table.from_batches(waiting))
    return Prepared(part, file, number, rows)


def _discard(path: str, messages: list[Prepared | None]) -> None:
    files, root = _files(path)
    for message in messages:
        if message is not None:
            files.delete_file(f"{root}/batches/{message.file}")


def _enter(path: str, delivery: str, messages: list[Prepared | None]) -> None:
    """Enter a delivery, unless it is there: then this run's files are of no use."""
    from pyarrow.fs import FileType

    files, root = _files(path)
    entry = f"{root}/ledger/{delivery}.json"
    if files.get_file_info(entry).type != FileType.NotFound:
        return _discard(path, messages)
    files.create_dir(f"{root}/ledger")
    parts = [vars(m) for m in messages if m is not None]
    beside = f"{root}/ledger/.{uuid.uuid4().hex}"
    with files.open_output_stream(beside) as out:
        out.write(json.dumps({"delivery": delivery, "parts": parts}).encode())
    files.move(beside, entry)


class _Options:
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.delivery, self.size = options["path"], options["delivery"], int(options["size"])
        self.schema = schema


class LedgerWriter(_Options, DataSourceArrowWriter):
    def write(self, iterator: Iterator) -> Prepared:
        return _prepare(self.path, self.delivery, self.size, self.schema, iterator)

    def commit(self, messages: list) -> None:
        _enter(self.path, self.delivery, messages)

    def abort(self, messages: list) -> None:
        _discard(self.path, messages)


class LedgerStreamWriter(_Options, DataSourceStreamArrowWriter):
    def write(self, iterator: Iterator) -> Prepared:
        # The number of the micro-batch is known to the commit only; it names the entry, not the rows.
        return _prepare(self.path, self.delivery, self.size, self.schema, iterator)

    def commit(self, messages: list, batchId: int) -> None:
        _enter(self.path, f"{self.delivery}-{batchId}", messages)

    def abort(self, messages: list, batchId: int) -> None:
        _discard(self.path, messages)


class LedgerSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delivery_ledger"

    def writer(self, schema: T.StructType, overwrite: bool) -> LedgerWriter:
        return LedgerWriter(dict(self.options), schema)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> LedgerStreamWriter:
        return LedgerStreamWriter(dict(self.options), schema)


def _checked(df: DataFrame, size: int, delivery: str) -> None:
    if size < 1 or not delivery or set(delivery) & set("/\\"):
        raise ValueError("a delivery needs a name without slashes and batches of one row or more")
    taken = [c for c in df.columns if c.lower() in KEYS]
    if taken:
        raise ValueError(f"column names that the delivery uses itself: {taken}")


def deliver_once(df: DataFrame, path: str, delivery: str, size: int) -> None:
    """Deliver a table in batches of ``size`` rows; a delivery of that name that is there already stays."""
    _checked(df, size, delivery)
    df.sparkSession.dataSource.register(LedgerSink)
    df.write.format("delivery_ledger").options(path=path, delivery=delivery, size=size).mode("append").save()


def deliver_stream(stream: DataFrame, path: str, delivery: str, size: int, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Deliver every micro-batch once; with ``once`` those there are now."""
    _checked(stream, size, delivery)
    stream.sparkSession.dataSource.register(LedgerSink)
    writer = stream.writeStream.format("delivery_ledger").options(path=path, delivery=delivery, size=size)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(delivery, part, file, batches, rows): what has been delivered."""
    entries = spark.read.schema(_ENTRY).json(f"{path}/ledger")
    return entries.select("delivery", F.inline("parts"))


def read_delivered(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The delivered rows with ``delivery``, ``part`` and ``batch_no``."""
    wide = T.StructType([*schema.fields, *(T.StructField(n, k) for n, k in zip(KEYS, (T.StringType(), T.LongType(), T.LongType())))])
    rows = spark.read.schema(wide).parquet(f"{path}/batches")
    named = rows.select("*", F.col("_metadata.file_name").alias("__file"))
    counted = read_ledger(spark, path).select(F.col("file").alias("__file"))
    return named.join(counted, "__file", "left_semi").drop("__file")
