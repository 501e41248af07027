"""Publishing rows as messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tableloom.functions.decode import encode_positional
from tableloom.operators.aggregates import in_batches
from tableloom.operators.columns import encode_key_json
from tableloom.sources.topics import KafkaTopic


def publish_kafka(df: DataFrame, topic: KafkaTopic, key: str | None = None) -> None:
    """One message per row, the row as JSON and the key as text, sent by all tasks at once."""
    messages = encode_key_json(df, key) if key else to_messages(df)
    messages.write.format("kafka").options(**topic.sink_options()).save()


def keyed_batches(
    df: DataFrame, key: str, order: Sequence[str], size: int, unique: bool = False, **limits: Any
) -> DataFrame:
    """(key, batch_no, n, items): the messages of each key, together and in batches.

    A message is the row as a JSON array of strings.
    """
    return in_batches(df, key, order, size, encode_positional(df.columns), unique, **limits)


def publish_batches(
    df: DataFrame, key: str, order: Sequence[str], size: int, send: Callable[[Iterator[Row]], None]
) -> None:
    """Hand the batches of all keys to ``send``, once per task.

    A retried task sends again, so ``send`` must cope with repeats of (key, batch_no). Ties
    in ``order`` are broken by content, so a repeat holds the same rows.
    """
    keyed_batches(df, key, order, size).foreachPartition(send)


def deliver(df: DataFrame, size: int, send: Callable[[int, list[Row]], None]) -> None:
    """Lists of at most ``size`` rows to ``send(partition, rows)``, on the executors."""

    def task(rows: Iterator[Row]) -> None:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        batch: list[Row] = []
        for row in rows:
            batch.append(row)
            if len(batch) == size:
                send(partition, batch)
                batch = []
        if batch:
            send(partition, batch)

    df.foreachPartition(task)


def to_messages(df: DataFrame) -> DataFrame:
    """(value): each row as one JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
