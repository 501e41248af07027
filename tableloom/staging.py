"""Written intermediate tables in the folder all executors share.

Anything that must be read twice with the same contents (numbered rows, drained
topics, stream checkpoints) is written below ``spark.checkpoint.dir``, so a lost
executor costs a re-read and not a recomputation with other contents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; removed at exit.

    A local session without the setting takes a folder below its warehouse; a cluster needs
    a folder every executor can see, so there the setting is required.
    """
    context = spark.sparkContext
    if context.applicationId not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.work"
        root = f"{base.rstrip('/')}/tableloom-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _roots[context.applicationId] = root
    return _roots[context.applicationId]


def path_exists(spark: SparkSession, path: str) -> bool:
    files, target = _at(spark, path)
    return files.exists(target)


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no folder."""
    files, target = _at(spark, path)
    return [status.getPath().getName() for status in files.listStatus(target)] if files.exists(target) else []


def read_small(spark: SparkSession, path: str) -> str:
    """A small text file, such as a marker or a log entry."""
    files, target = _at(spark, path)
    data = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
    finally:
        data.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears as a whole; one of that name is replaced."""
    files, target = _at(spark, path)
    _, beside = _at(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = files.create(beside)
    out.write(text.encode())
    out.close()
    if files.exists(target):
        files.delete(target, False)
    if not files.rename(beside, target):
        raise OSError(f"could not write {path}")


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a file or folder to a name that is free, within one file system."""
    files, new = _at(spark, target)
    _, old = _at(spark, source)
    if files.exists(new) or not files.rename(old, new):
        raise OSError(f"could not move {source} to {target}")


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path for a table, a topic or a checkpoint."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet and return the written table: the lineage ends here."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_unless_empty(df: DataFrame, label: str = "stage") -> DataFrame | None:
    """Like ``stage``, but None when nothing was written; the write itself counts."""
    observation = Observation()
    staged = stage(df.observe(observation, F.count(F.lit(1)).alias("rows")), label)
    return staged if observation.get["rows"] else None
