"""Session settings and the place where lineage is cut."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "docloom", memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        # Small test tables: keep all cores busy after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        # Call sites of single column operations are not needed; recording them costs more
        # than building the plans does.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


#: Rows that a task of CPU-bound work takes.
TASK_ROWS = 1 << 10


def tasks_for(spark: SparkSession, rows: int, task_rows: int = TASK_ROWS) -> int:
    """Tasks for CPU-bound work on so many rows: all cores, and a bounded number of rows each."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / task_rows))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals an input over all cores before CPU-bound work.

    The number of splits says little: a file has its rows in as few of them as it has row
    groups.  So the rows of each split are counted, which reads no column; only an input
    with a split of more than twice a task's share is moved.
    """
    spark = df.sparkSession
    held = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    rows, largest = held[0] or 0, held[1] or 0
    tasks = tasks_for(spark, rows)
    return df.repartition(tasks, key) if largest * tasks > 2 * rows else df


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="docloom-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def stored(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: joins with it know its true size."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed once and stored where losing executors cannot lose it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
