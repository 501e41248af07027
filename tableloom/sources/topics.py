"""Message topics. Kafka needs the spark-sql-kafka package on the class path."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

STARTS = ("earliest", "latest")


@dataclass(frozen=True)
class KafkaTopic:
    servers: str
    topic: str
    starting_offsets: str = "earliest"
    properties: Mapping[str, str] = field(default_factory=dict)

    def _common(self) -> dict[str, str]:
        if not self.servers or not self.topic:
            raise ValueError("a topic needs servers and a name")
        return {"kafka.bootstrap.servers": self.servers, **self.properties}

    def source_options(self) -> dict[str, str]:
        start = self.starting_offsets
        if start not in STARTS and not start.startswith("{"):
            raise ValueError("starting_offsets is earliest, latest or a JSON object")
        return {**self._common(), "subscribe": self.topic, "startingOffsets": start}

    def sink_options(self) -> dict[str, str]:
        return {**self._common(), "topic": self.topic}


def read_topic_stream(spark: SparkSession, topic: KafkaTopic) -> DataFrame:
    """(key, value) as text, plus topic, partition and offset; ordered within a partition only."""
    raw = spark.readStream.format("kafka").options(**topic.source_options()).load()
    return raw.selectExpr(
        "CAST(key AS STRING) AS key",
        "CAST(value AS STRING) AS value",
        "topic",
        "partition",
        "offset",
    )
