"""Session helpers: a local session for tests and bench, and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK_CONF = "spark.peptarium.rowsPerTask"
ROWS_PER_TASK_DEFAULT = 2_000_000


def local_session(cpus: str | int = "*", app: str = "peptarium", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PEPTARIUM_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def rows_per_task(spark: SparkSession) -> int:
    """How many rows one task may sort or hold; beyond it work is cut into slices."""
    return int(spark.conf.get(ROWS_PER_TASK_CONF, str(ROWS_PER_TASK_DEFAULT)))


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines see, from ``spark.checkpoint.dir``.

    Without that setting a fresh local folder serves a ``local`` master; on a cluster it is an error,
    since executors do not see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage there; Spark removes it with the last reference."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def freeze_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``freeze``, with the row count taken from the write itself."""
    seen = Observation()
    frozen = freeze(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return frozen, int(seen.get["n"])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give per-row heavy work at least one partition per core.

    Only acts on inputs read as fewer partitions than there are cores, such as one small file with a
    single row group. Large tables are never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, *keys) if df.rdd.getNumPartitions() < cores else df


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared folder, for tables that are written and read back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
