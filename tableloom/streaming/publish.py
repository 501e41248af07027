"""Streams that end in a topic, in files or in a running result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tableloom.operators.columns import encode_key_json
from tableloom.sources.topics import KafkaTopic, read_topic_stream
from tableloom.staging import new_path


def publish_stream(
    messages: DataFrame, topic: KafkaTopic, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Send (key, value) messages as they come, or with ``once`` those there are now."""
    writer = messages.writeStream.format("kafka").options(**topic.sink_options())
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def copy_topic(spark, source: KafkaTopic, sink: KafkaTopic, checkpoint: str) -> StreamingQuery:
    """Copy messages from one topic to another one; never into itself."""
    if (source.servers, source.topic) == (sink.servers, sink.topic):
        raise ValueError("source and sink are the same topic")
    stream = read_topic_stream(spark, source).select("key", "value")
    return publish_stream(stream, sink, checkpoint)


def copy_files(stream: DataFrame, source: str, sink: str, checkpoint: str) -> None:
    """Copy a file stream to its present end; a restart copies only what is new."""
    if source.rstrip("/") == sink.rstrip("/"):
        raise ValueError("source and sink are the same folder")
    (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def encode_stream(stream: DataFrame, key: str) -> DataFrame:
    """Stream rows as (key, value) messages."""
    return encode_key_json(stream, key)


def running_result(result: DataFrame) -> DataFrame:
    """Run a streaming aggregate in complete mode to its present end; return the last result.

    Each micro-batch replaces the written result, so a restarted batch leaves no trace.
    """
    spark = result.sparkSession
    path, checkpoint = new_path(spark, "result"), new_path(spark, "checkpoint")

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    (
        result.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(result.schema).parquet(path)
