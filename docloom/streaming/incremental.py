"""Incremental runs of the dataset job over a landing folder.

The job is narrow from scan to sink, so it needs no state: each run takes the files that
landed since the last one, as its checkpoint records them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.sinks import dataset_rows, hour_bucket
from docloom.plans.dataset import dataset

LANDED_SCHEMA = "path string, content string"


def landed_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of ``(path, content)`` rows landed as parquet files."""
    return (
        spark.readStream.schema(LANDED_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def run_available(files: DataFrame, output: str, checkpoint: str) -> None:
    """Appends dataset rows of all files landed so far, by hour bucket, and stops.

    The file sink records its batches, so a restarted run neither loses nor repeats rows.
    """
    rows = dataset_rows(dataset(files)).withColumn("bucket", hour_bucket(F.current_timestamp()))
    running = (
        rows.writeStream.format("json")
        .partitionBy("bucket")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
