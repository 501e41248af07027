"""Reading a topic or folder to its present end, or until its producer has finished.

A drain takes what was there when it started. What arrives later belongs to the next
drain on the same checkpoint, which goes on where this one stopped. ``drain_until_finished`` waits
instead, until everything the producer has sent in all is written.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tableloom.sources.folder_topic import FolderTopic, read_folder_topic
from tableloom.staging import names_in, new_path, read_small


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    format: str = "parquet",
    **options: str,
) -> DataFrame:
    """A stream over a folder or pattern; new files are new messages."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


@dataclass(frozen=True)
class Drain:
    """A stream to drain into Parquet. Without a checkpoint it starts from the beginning."""

    stream: DataFrame
    transform: Callable[[DataFrame], DataFrame] | None = None
    path: str | None = None
    checkpoint: str | None = None
    partition_by: Sequence[str] = ()


def drain_all(drains: Sequence[Drain]) -> list[DataFrame]:
    """Drain several streams side by side; a failed one fails the call."""
    running: list[tuple[StreamingQuery, str, DataFrame]] = []
    try:
        for item in drains:
            spark = item.stream.sparkSession
            path = item.path or new_path(spark, "drained")
            checkpoint = item.checkpoint or new_path(spark, "checkpoint")
            rows = item.transform(item.stream) if item.transform else item.stream
            query = (
                rows.writeStream.format("parquet")
                .outputMode("append")
                .option("path", path)
                .option("checkpointLocation", checkpoint)
                .partitionBy(*item.partition_by)
                .trigger(availableNow=True)
                .start()
            )
            running.append((query, path, rows))
        for query, _, _ in running:
            query.awaitTermination()
    except BaseException:
        for query, _, _ in running:
            query.stop()
        raise
    return [r.sparkSession.read.schema(r.schema).parquet(p) for _, p, r in running]


def drain(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    path: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Drain one stream and return the written rows."""
    return drain_all([Drain(stream, transform, path, checkpoint)])[0]


def entries_taken(spark: SparkSession, checkpoint: str) -> int:
    """How many entries of a folder topic the batches committed under ``checkpoint`` hold."""
    done = [int(name) for name in names_in(spark, f"{checkpoint}/commits") if name.isdigit()]
    if not done:
        return 0
    offsets = read_small(spark, f"{checkpoint}/offsets/{max(done)}").strip().splitlines()
    return int(json.loads(offsets[-1])["entries"])


def drain_until_finished(
    spark: SparkSession,
    topic: FolderTopic,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    path: str | None = None,
    checkpoint: str | None = None,
    poll: float = 0.2,
    patience: float | None = None,
) -> DataFrame:
    """Drain a folder topic until its producer has finished and its last entry is written.

    An empty topic alone is no end. With ``patience``, that many seconds without a new entry raise
    TimeoutError; what was written stays, and the same path and checkpoint go on from there.
    """
    stream = read_folder_topic(spark, topic)
    rows = transform(stream) if transform else stream
    path, checkpoint = path or new_path(spark, "drained"), checkpoint or new_path(spark, "checkpoint")
    query = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{int(1000 * poll)} milliseconds")
        .start()
    )
    try:
        taken, since = 0, time.monotonic()
        while True:
            query.awaitTermination(poll)  # raises what the query failed with
            now, last = entries_taken(spark, checkpoint), topic.finished_at(spark)
            if last is not None and now >= last:
                break
            if now > taken:
                taken, since = now, time.monotonic()
            elif patience is not None and time.monotonic() - since > patience:
                raise TimeoutError(f"no entry after {taken} for {patience} seconds, and the producer has not finished")
    finally:
        query.stop()
    return spark.read.schema(rows.schema).parquet(path)
