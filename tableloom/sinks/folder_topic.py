"""The producer of a folder topic."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from tableloom.sources.folder_topic import FINISHED, entry_name
from tableloom.staging import path_exists, rename, write_small


class FolderProducer:
    """Sends tables as entries. An entry is there as a whole or not at all, and is never replaced."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.reserved = spark, path, 0

    def reserve(self, entries: int = 1) -> int:
        """The first of so many places, to be filled in any order."""
        first, self.reserved = self.reserved, self.reserved + entries
        return first

    def send(self, df: DataFrame, at: int | None = None) -> int:
        """Write ``df`` beside the topic and move it to its place; an entry that is there already stays.

        So a producer that starts over with the same places sends nothing twice.
        """
        at = self.reserve() if at is None else at
        self.reserved = max(self.reserved, at + 1)
        place = f"{self.path}/{entry_name(at)}"
        if path_exists(self.spark, place):
            return at
        sending = f"{self.path}/_sending-{uuid.uuid4().hex}"
        df.write.parquet(sending)
        rename(self.spark, sending, place)
        return at

    def finish(self) -> None:
        """No entry follows those reserved so far."""
        missing = [n for n in range(self.reserved) if not path_exists(self.spark, f"{self.path}/{entry_name(n)}")]
        if missing:
            raise ValueError(f"entries were reserved and not sent: {missing[:10]}")
        write_small(self.spark, f"{self.path}/{FINISHED}", json.dumps({"entries": self.reserved}))
