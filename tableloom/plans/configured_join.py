"""Two sources, a join by configuration, a guarded write and a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tableloom.functions.decode import decode_positional, split_rejects
from tableloom.functions.schema import import_schema
from tableloom.operators.joins import equi_join
from tableloom.plans.federated import Source, Target, guard_target, read_sources, rejected, write_target
from tableloom.sinks.report import RunReport, write_with_report
from tableloom.streaming.drain import Drain, drain_all


@dataclass(frozen=True)
class JoinConfig:
    unique_key_left: str | Sequence[str]
    unique_key_right: str | Sequence[str]
    join_type: str = "inner"
    repair: str = "suffix"

    @classmethod
    def from_options(cls, options: Mapping[str, Any]) -> "JoinConfig":
        """From job options: unique_key_left, unique_key_right, join_type."""
        missing = [k for k in ("unique_key_left", "unique_key_right", "join_type") if not options.get(k)]
        if missing:
            raise ValueError(f"missing join options: {missing}")
        return cls(options["unique_key_left"], options["unique_key_right"], options["join_type"])


@dataclass(frozen=True)
class Topic:
    """A stream of JSON-array messages and the descriptor of its rows."""

    stream: DataFrame
    schema: str | dict
    keep_rejects: bool = False


def drain_topics(topics: Sequence[Topic]) -> list[tuple[DataFrame, DataFrame]]:
    """(good rows, rejects) per topic; the topics drain side by side."""
    drains = [
        Drain(t.stream, lambda s, specs=import_schema(t.schema): decode_positional(s, specs))
        for t in topics
    ]
    return [split_rejects(rows) for rows in drain_all(drains)]


def join_topics(
    left: Topic, right: Topic, config: JoinConfig, rejects: list[DataFrame] | None = None
) -> DataFrame:
    """Drain both topics and join them.

    Rejected messages fail the job. A topic with ``keep_rejects`` goes on without them; they
    stay in its drained table and are appended to ``rejects``, with their errors.
    """
    (l, l_bad), (r, r_bad) = drain_topics([left, right])
    for topic, bad in ((left, l_bad), (right, r_bad)):
        if topic.keep_rejects:
            if rejects is not None:
                rejects.append(bad)
        elif not bad.isEmpty():
            raise ValueError("a topic has messages that do not fit their schema")
    return _join(l, r, config)


def _join(left: DataFrame, right: DataFrame, config: JoinConfig) -> DataFrame:
    return equi_join(
        left, right, config.unique_key_left, config.unique_key_right, config.join_type, config.repair
    )


def run_join(spark: SparkSession, left: Source, right: Source, config: JoinConfig, target: Target) -> RunReport:
    """Check the target, join, write; the report is counted by the write itself.

    The target is files, a table or a topic. Streams on both sides drain side by side.
    """
    guard_target(spark, target)
    rejects: list[DataFrame] = []
    joined = _join(*read_sources(spark, [left, right], rejects), config)
    return write_with_report(joined, lambda df: write_target(df, target), rejected=rejected(rejects))
