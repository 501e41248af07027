"""Database tables and queries over JDBC. The driver jar comes with the cluster."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Split:
    """A parallel read: ranges of a number, date or timestamp column.

    Bounds only shape the ranges; rows outside them are read by the outer ranges.
    """

    column: str
    lower: str
    upper: str
    partitions: int = 10


@dataclass(frozen=True)
class JdbcSource:
    """A table or a query, which the database runs."""

    url: str
    table: str | None = None
    query: str | None = None
    driver: str | None = None
    user: str | None = None
    password: str | None = None
    fetch_size: int = 10_000
    split: Split | None = None
    session_init: str | None = None
    properties: Mapping[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        """Reader options. Spark allows no ``query`` with a split, so it becomes a subquery."""
        if bool(self.table) == bool(self.query):
            raise ValueError("give either a table or a query")
        options = {"url": self.url, "fetchsize": str(self.fetch_size), **self.properties}
        for name, value in (
            ("driver", self.driver),
            ("user", self.user),
            ("password", self.password),
            ("sessionInitStatement", self.session_init),
        ):
            if value:
                options[name] = value
        if self.query and not self.split:
            options["query"] = self.query
        else:
            options["dbtable"] = self.table or f"({self.query}) source_query"
        if self.split:
            if self.split.partitions < 1:
                raise ValueError("a split has at least one partition")
            options |= {
                "partitionColumn": self.split.column,
                "lowerBound": str(self.split.lower),
                "upperBound": str(self.split.upper),
                "numPartitions": str(self.split.partitions),
            }
        return options


def read_jdbc(spark: SparkSession, source: JdbcSource) -> DataFrame:
    return spark.read.format("jdbc").options(**source.options()).load()


def measured_split(
    spark: SparkSession, source: JdbcSource, column: str, partitions: int = 10
) -> Split:
    """A split whose bounds are the smallest and largest value, found by the database."""
    origin = source.table or f"({source.query}) source_query"
    bounds = JdbcSource(
        url=source.url,
        query=f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {origin}",
        driver=source.driver,
        user=source.user,
        password=source.password,
        session_init=source.session_init,
        properties=source.properties,
    )
    low, high = read_jdbc(spark, bounds).first()
    if low is None:
        raise ValueError(f"no values in {column!r}")
    return Split(column, str(low), str(high), partitions)
