"""Session settings, and the shared folder used to cut lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # only some C libraries keep freed memory back, and have this to release it
    _trim = None

# Defaults for a session this package creates itself (tests, bench, spark-submit without its own settings).
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app_name: str = "argotlog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this package's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the checkpoint folder that the session has already.

    A session on one machine that names none gets a temporary folder.  On a cluster that would be a folder of the driver alone, so there
    the setting is asked for.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    folder = folder or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="argotlog-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


# Folders of the runs that are going on, the innermost last.
_runs: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, or below that of the run that is going on."""
    base = _runs[-1] if _runs else shared_folder(spark)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all tables that are materialised meanwhile; frames that read them are of no use afterwards."""
    folder = scratch_path(spark, "run")
    _runs.append(folder)
    try:
        yield
    finally:
        _runs.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and go on from there, which cuts its lineage.

    A Parquet table is preferred to an RDD checkpoint: readers prune its columns, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    with small_batches(spark):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows reach Python in batches of a few megabytes, whatever their size."""
    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.set(key, "8m")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(*frames: DataFrame) -> None:
    """Delete tables that `materialize` has written and that no frame in use reads any more; other frames are left alone."""
    for frame in frames:
        folder = getattr(frame, "_scratch", None)
        if folder is not None:
            spark = frame.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table of very few files over all cores before row-wise text work; a table of many files stays as it is.

    The bound is an eighth of the cores (at least 8 partitions), so what is shuffled is small for the cluster at hand.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= max(8, cores // 8) and cores > 1 else df


def give_back() -> None:
    """Return freed memory to the machine: a worker that waits for its next task, or its neighbour's, should not hold it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
