"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docloom.session import checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder; nothing is created yet."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "llm") -> DataFrame:
    """The frame written as a table all executors can reach, and read back: lineage ends here."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
