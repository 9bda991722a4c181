"""Session settings the operators are designed for, and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cpus: int = 8, name: str = "rosterspark", extra: dict[str, str] | None = None) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    options = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.enabled": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="rosterspark-"),
        "spark.driver.memory": os.environ.get("ROSTERSPARK_DRIVER_MEMORY", "8g"),
        **SETTINGS,
        **(extra or {}),
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``. A local session without it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="rosterspark-")
    return _OWN_FOLDERS[context.applicationId]


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/rosterspark-{uuid.uuid4().hex}"


class Staging:
    """Tables that were staged while this is open; see ``staging``."""

    def __init__(self, spark: SparkSession, outer: Staging | None):
        self.spark, self.outer, self.paths = spark, outer, []

    def keep(self, df: DataFrame) -> DataFrame:
        """Stage ``df`` so that it outlives this block; it goes with the block around it, if there is one."""
        return _write(df, self.outer)


_STAGING: ContextVar[Staging | None] = ContextVar("staging", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[Staging]:
    """Remove all tables that are staged inside the block when it ends: run a job and write its results within one."""
    block = Staging(spark, _STAGING.get())
    token = _STAGING.set(block)
    try:
        yield block
    finally:
        _STAGING.reset(token)
        _remove(spark, block.paths)


def _write(df: DataFrame, block: Staging | None) -> DataFrame:
    path = new_folder(df.sparkSession)
    if block is not None:
        block.paths.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(conf).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read on from there: the lineage is cut, columns stay prunable.

    The table goes at the end of the ``staging`` block around the call, or by ``drop_staged``.
    """
    return _write(df, _STAGING.get())


def drop_staged(df: DataFrame) -> None:
    """Remove the files behind a frame that ``staged`` gave."""
    _remove(df.sparkSession, [df.staged_path])
