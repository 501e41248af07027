"""A join of two topics that goes on: each step joins what is new with all there was before.

Both sides are stored as they are drained, a folder per step. A step drains what is new (L', R') and
adds the matches of L' with all of R, and of the earlier L with R'. So no pair is joined twice and none
is missed, whichever side its later row came on. Outer rows are not known before the end: ``result``
adds the rows that have found no partner up to now.

A step counts once its marker is written. One that died starts again under its number: its drains go
on where they were, and its matches are written over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.decode import decode_positional, split_rejects
from tableloom.functions.schema import import_schema
from tableloom.operators.joins import equi_join
from tableloom.plans.configured_join import JoinConfig, Topic
from tableloom.staging import names_in, write_small
from tableloom.streaming.drain import Drain, drain_all

STEP = "__step"
OUTER = {"inner": (), "left": ("left",), "right": ("right",), "full": ("left", "right")}


class ContinuedJoin:
    """State below ``path``: ``left`` and ``right`` with checkpoints, ``matches``, ``steps``.

    Rejected messages stop a step before it counts, unless their topic keeps rejects; those
    of all steps are in ``rejects``.
    """

    def __init__(self, spark: SparkSession, path: str, config: JoinConfig):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.kind = config.join_type.lower().removesuffix("outer").rstrip("_") or "full"
        if self.kind not in OUTER:
            raise ValueError(f"a join that goes on is {', '.join(OUTER)}, not {config.join_type}")

    def steps(self) -> int:
        """How many steps count."""
        return len([n for n in names_in(self.spark, f"{self.path}/steps") if n.isdigit()])

    def _drained(self, topics: dict[str, Topic], step: int) -> dict[str, DataFrame]:
        def decoded(topic: Topic):
            specs = import_schema(topic.schema)
            return lambda stream: decode_positional(stream, specs).withColumn(STEP, F.lit(step))

        drains = [
            Drain(topic.stream, decoded(topic), f"{self.path}/{side}", f"{self.path}/{side}-checkpoint", (STEP,))
            for side, topic in topics.items()
        ]
        return dict(zip(topics, drain_all(drains)))

    def advance(self, left: Topic, right: Topic) -> DataFrame:
        """Drain what is new on both sides, store its matches, and return them."""
        step = self.steps()
        topics = {"left": left, "right": right}
        stored = self._drained(topics, step)
        for side, rows in stored.items():
            bad = split_rejects(rows.where(F.col(STEP) == step))[1]
            if not topics[side].keep_rejects and not bad.isEmpty():
                raise ValueError(f"the {side} topic has messages that do not fit their schema")
        l, r = (split_rejects(stored[side])[0].where(F.col(STEP) <= step) for side in ("left", "right"))
        new = lambda rows: rows.where(F.col(STEP) == step).drop(STEP)
        matches = self._join(new(l), r.drop(STEP), "inner")
        if step:
            matches = matches.unionAll(self._join(l.where(F.col(STEP) < step).drop(STEP), new(r), "inner"))
        where = f"{self.path}/matches/{STEP}={step}"
        matches.write.mode("overwrite").parquet(where)
        write_small(self.spark, f"{self.path}/steps/{step}", "done")
        return self.spark.read.schema(matches.schema).parquet(where)

    def _join(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        c = self.config
        return equi_join(left, right, c.unique_key_left, c.unique_key_right, how, c.repair)

    def side(self, name: str, schema: DataFrame) -> DataFrame:
        """The stored good rows of a side; ``schema`` is any frame with the drained columns."""
        rows = self.spark.read.schema(schema.schema).parquet(f"{self.path}/{name}")
        return split_rejects(rows.where(F.col(STEP) < self.steps()))[0].drop(STEP)

    def _shape(self, topic: Topic) -> DataFrame:
        empty = self.spark.createDataFrame([], "value string")
        return decode_positional(empty, import_schema(topic.schema)).withColumn(STEP, F.lit(0))

    def rejects(self, name: str, topic: Topic) -> DataFrame:
        """The rejected messages of a side, with their errors."""
        rows = self.spark.read.schema(self._shape(topic).schema).parquet(f"{self.path}/{name}")
        return split_rejects(rows.where(F.col(STEP) < self.steps()))[1].drop(STEP)

    def result(self, left: Topic, right: Topic) -> DataFrame:
        """The join of everything drained so far; the topics are asked for their schemas only."""
        if not self.steps():
            raise ValueError("no step has been done")
        l, r = self.side("left", self._shape(left)), self.side("right", self._shape(right))
        shape = self._join(l.limit(0), r.limit(0), self.kind).schema
        folders = [f"{self.path}/matches/{STEP}={n}" for n in range(self.steps())]
        joined = self.spark.read.schema(shape).parquet(*folders)
        c = self.config
        for name in OUTER[self.kind]:
            if name == "left":
                alone = equi_join(l, r, c.unique_key_left, c.unique_key_right, "left_anti")
                joined = joined.unionAll(self._join(alone, r.limit(0), "left"))
            else:
                alone = equi_join(r, l, c.unique_key_right, c.unique_key_left, "left_anti")
                joined = joined.unionAll(self._join(l.limit(0), alone, "right"))
        return joined
