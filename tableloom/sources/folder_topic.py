"""A topic in a folder: numbered entries of Parquet files, and a marker once the producer is done.

Layout below the topic's path: ``000000000000/``, ``000000000001/``, ... each the part files of what was
sent at once, put there by one rename; ``_finished`` names the number of entries. Entries may arrive out of
turn; a stream's offset is the number of entries that are there without a gap, so a late
entry holds back those behind it and none is passed over.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tableloom.staging import path_exists, read_small

# The source runs in Python workers, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FINISHED = "_finished"
PROBES = 64  # entries asked for at once
TASK_BYTES = 128 << 20


def entry_name(number: int) -> str:
    return f"{number:012d}"


@dataclass(frozen=True)
class FolderTopic:
    path: str
    schema: T.StructType

    def finished_at(self, spark: SparkSession) -> int | None:
        """The number of entries the producer has sent in all, or None while it still sends."""
        marker = f"{self.path}/{FINISHED}"
        return int(json.loads(read_small(spark, marker))["entries"]) if path_exists(spark, marker) else None


def read_folder_topic(spark: SparkSession, topic: FolderTopic) -> DataFrame:
    """The topic as a stream. A column that a file lacks is NULL."""
    spark.dataSource.register(FolderTopicSource)
    return spark.readStream.format("folder_topic").schema(topic.schema).load(topic.path)


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


@dataclass
class FileSpan(InputPartition):
    """Row groups of one file."""

    path: str
    first: int
    end: int | None


class FolderTopicReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.known = path, schema, 0

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        """The entries without a gap; only what may be new is looked for."""
        from pyarrow.fs import FileType

        files, root = _files(self.path)
        while True:
            infos = files.get_file_info([f"{root}/{entry_name(self.known + i)}" for i in range(PROBES)])
            there = next((i for i, info in enumerate(infos) if info.type == FileType.NotFound), PROBES)
            self.known += there
            if there < PROBES:
                return {"entries": self.known}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """A task for each file; large files are cut at row groups."""
        from pyarrow import fs, parquet

        files, root = _files(self.path)
        spans: list[InputPartition] = []
        for number in range(start["entries"], end["entries"]):
            for info in files.get_file_info(fs.FileSelector(f"{root}/{entry_name(number)}")):
                if not info.base_name.endswith(".parquet") or info.base_name[0] in "._":
                    continue
                if info.size <= TASK_BYTES:
                    spans.append(FileSpan(info.path, 0, None))
                    continue
                with files.open_input_file(info.path) as data:
                    groups = parquet.ParquetFile(data).num_row_groups
                step = max(1, groups * TASK_BYTES // info.size)
                spans += [FileSpan(info.path, g, min(g + step, groups)) for g in range(0, groups, step)]
        return spans

    def read(self, partition: FileSpan) -> Iterator:
        import pyarrow as pa
        from pyarrow import parquet
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        files, _ = _files(self.path)
        with files.open_input_file(partition.path) as data:
            source = parquet.ParquetFile(data)
            there = set(source.schema_arrow.names)
            columns = [f.name for f in wanted if f.name in there]
            end = source.num_row_groups if partition.end is None else partition.end
            for batch in source.iter_batches(row_groups=list(range(partition.first, end)), columns=columns):
                arrays = [
                    batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in wanted
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=wanted)

    def commit(self, end: dict) -> None:
        """Entries before ``end`` are taken; nothing before it is asked for again."""
        self.known = max(self.known, end["entries"])


class FolderTopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_topic"

    def streamReader(self, schema: T.StructType) -> FolderTopicReader:
        return FolderTopicReader(self.options["path"], schema)
