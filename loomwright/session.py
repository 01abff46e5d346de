"""The session, the shared folder for cut lineage, and table access."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "loomwright", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=conf).getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset (tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/loomwright-checkpoints-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", folder) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, without their lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_PATHS: list[str] = []  # what this process has written into the shared folder
_LOCK = threading.Lock()


def _own(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}"
    with _LOCK:
        _PATHS.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the tables that `written` and `bucketed` have left in the shared folder; the number of them.

    To be called when no result that reads them is needed any more. Checkpoints are left to spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    with _LOCK:
        paths, _PATHS[:] = list(_PATHS), []
    jvm = spark.sparkContext._jvm
    for x in paths:
        p = jvm.org.apache.hadoop.fs.Path(x)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        name = x.rsplit("/", 1)[-1]
        if "-" not in name:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table in the shared folder: column pruning, and sizes that the planner knows."""
    spark = df.sparkSession
    path = _own(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, col: str) -> DataFrame:
    """The same rows as a table in the shared folder, bucketed and sorted by a column: joins and groupings by it move none of them."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = f"{name}_{uuid.uuid4().hex}"
    path = _own(spark, full)
    df.repartition(n, col).write.option("path", path).bucketBy(n, col).sortBy(col).saveAsTable(full)
    return spark.table(full)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Query = Callable[[SparkSession, str], DataFrame]
