"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Folders written by this process, oldest first.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where the setting is absent and all runs on one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fieldtree-"))
    return context.getCheckpointDir().rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``release`` can delete."""
    folder = f"{shared_dir(spark)}/fieldtree/{uuid.uuid4().hex}"
    _written.append(folder)
    return f"{folder}/{name}"


def stored(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut lineage, safe from lost executors, of known size.

    ``counts`` are aggregates of its rows; they come with the write, not from a job of their own, and are the
    ``metrics`` of what is returned.
    """
    path, seen = fresh(df.sparkSession, name), None
    if counts:
        seen = Observation()
        df = df.observe(seen, *(c.alias(k) for k, c in counts.items()))
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_at, made.metrics = _written[-1], dict.fromkeys(counts, 0) | (seen.get if counts else {})
    if counts:
        log.info("%s: %s", name, made.metrics)
    return made


def mark() -> int:
    """Now, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Delete what was written to the shared folder since a mark, but the last few; the number of folders.

    Results that still read these tables must have been written elsewhere or not be needed any more.
    """
    stop = max(since, len(_written) - but)
    folders = _written[since:stop]
    del _written[since:stop]
    _delete(spark, folders)
    return len(folders)


def discarded(table: DataFrame, then: DataFrame) -> DataFrame:
    """``then``, after the table (of ``stored``), which nothing reads any more, has been deleted."""
    if table.stored_at in _written:
        _written.remove(table.stored_at)
    _delete(table.sparkSession, [table.stored_at])
    return then


def _delete(spark: SparkSession, folders: list[str]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        at = path(folder)
        at.getFileSystem(conf).delete(at, True)
    if folders:
        spark._jvm.System.gc()  # the engine deletes shuffles of tables that are gone once they are collected
