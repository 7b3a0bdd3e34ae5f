"""Source trees, dataset files and CSV tables as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType(), True) for name in ("repo", "path", "content")]
)
DATASET_SCHEMA = (
    "name string, comment string, comment_analysis struct<tokens: array<string>, lemmas: array<string>, "
    "pos_tags: array<string>, entities: array<array<string>>>, file_name string"
)
_BAD = "_bad_line"


def scan_go_files(spark: SparkSession, roots: str | Sequence[str]) -> DataFrame:
    """``(path, content, modified_at)`` of the ``*.go`` files under folders, or of single
    files.  A path is relative to its root, so a root inside ``vendor`` is no filter.

    Many small files: land the result once as parquet and read that.  Spark skips
    entries whose names start with a dot or an underscore.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.go")
        .load(roots)
    )
    return files.select(
        _below(F.col("path"), roots).alias("path"),
        F.decode("content", "utf-8").alias("content"),
        F.col("modificationTime").alias("modified_at"),
    )


def _below(path: Column, roots: Sequence[str]) -> Column:
    relative = path
    for root in sorted(roots, key=len):
        plain = re.escape(re.sub(r"^[a-z0-9]+:/+", "/", root).rstrip("/"))
        inside = rf"^(?:[a-z0-9]+:/*)?/?{plain.lstrip('/')}/(.+)$" if not root.endswith(".go") else None
        if inside:
            relative = F.when(path.rlike(inside), F.regexp_extract(path, inside, 1)).otherwise(relative)
    return relative


def files_from_rows(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A few ``(repo, path, content)`` rows held in memory; larger sets are landed."""
    return spark.createDataFrame(list(rows), FILES_SCHEMA)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Stored dataset rows with their fixed schema."""
    return spark.read.schema(DATASET_SCHEMA).json(path)


def read_dataset_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(source, block, line, record, error)``: every line, in file order by the first
    three columns; ``error`` holds the text of a line that is no record."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    return parse_dataset_lines(lines)


def parse_dataset_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    others = [c for c in lines.columns if c != value]
    record = F.from_json(
        value, f"{DATASET_SCHEMA}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    )
    parsed = lines.withColumn("record", record)
    bad = F.when(F.col("record").isNull(), F.col(value)).otherwise(F.col(f"record.{_BAD}"))
    return parsed.select(*others, F.col("record").dropFields(_BAD).alias("record"), bad.alias("error"))


def valid_rows(lines: DataFrame) -> DataFrame:
    others = [c for c in lines.columns if c not in ("record", "error")]
    return lines.filter(F.col("error").isNull()).select(*others, "record.*")


def rejected_rows(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("error").isNotNull()).drop("record")


def read_newest_dataset(
    spark: SparkSession, folder: str, prefix: str = "", extension: str = ".jsonl"
) -> DataFrame:
    """The dataset file changed last among those of the right name; an error when none is."""
    from docloom.sources.listings import newest_file

    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{extension}").load(folder)
        .select("path", F.substring_index("path", "/", -1).alias("name"), F.col("modificationTime").alias("modified_at"))
    )
    newest = newest_file(listing, prefix, extension).first()
    if newest is None:
        raise FileNotFoundError(f"no {prefix}*{extension} in {folder}")
    return read_dataset(spark, newest["path"])


def read_table_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header.  Quoted values may span lines, so a file is one task;
    land large tables as parquet."""
    return spark.read.options(header=True, inferSchema=True, multiLine=True, escape='"').csv(path)
