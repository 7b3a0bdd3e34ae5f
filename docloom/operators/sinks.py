"""Writers.  All write folders of part files; nothing is overwritten in place."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import stored

# Fixed value: hour bucket of the dataset, as in ``20240131_07``.
HOUR_BUCKET = "yyyyMMdd_HH"


def hour_bucket(ts: Column) -> Column:
    return F.date_format(ts, HOUR_BUCKET)


def dataset_rows(graded_rows: DataFrame) -> DataFrame:
    """The stored row layout; entities become two-element arrays, the grade is dropped."""
    a = F.col("comment_analysis")
    entities = F.transform(a["entities"], lambda e: F.array(e["text"], e["label"]))
    return graded_rows.select(
        "name", "comment", a.withField("entities", entities).alias("comment_analysis"), "file_name"
    )


def append_dataset(rows: DataFrame, folder: str, ts: Column | None = None, distinct: bool = False) -> None:
    """Appends JSON lines under the hour bucket.  A second run of the same hour adds its
    rows again unless ``distinct`` drops repeated (name, comment) pairs of this run."""
    rows = rows.dropDuplicates(["name", "comment"]) if distinct else rows
    bucket = hour_bucket(F.current_timestamp() if ts is None else ts)
    rows.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").json(folder)


def append_once(rows: DataFrame, folder: str, ts: Column | None = None, distinct: bool = False) -> None:
    """Appends JSON lines under the hour bucket, as often as a run holds them and no more.

    What stands in the hour already, from an earlier run or from one that broke off, is
    counted by row digest, and only what is missing is written.  So a run may be repeated
    until it succeeds: any number of runs leaves the rows of one.  Two runs with different
    rows leave, of each row, the larger of its two counts.  ``distinct`` takes each row of
    the run once.

    Counts meet before a shuffle, so a row that is repeated very often is no hot group.
    Only the buckets of this run are read; the others stay as they are.  A line that a
    broken run left half written is no row.  Runs of one hour must not overlap in time.
    """
    spark = rows.sparkSession
    # One instant for the whole call, whatever the plans that mention it.
    now = F.lit(spark.range(1).select(F.current_timestamp()).first()[0])
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])), 256)
    placed = rows.select(hour_bucket(now if ts is None else ts).alias("_bucket"), digest.alias("_digest"), F.struct(*rows.columns).alias("_row"))
    counted = placed.groupBy("_bucket", "_digest").agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_n"))
    counted = stored(counted.withColumn("_n", F.lit(1).cast("long")) if distinct else counted)
    buckets = [r[0] for r in counted.select("_bucket").distinct().collect()]
    try:
        landed = spark.read.schema(T.StructType([*rows.schema, T.StructField("bucket", T.StringType())])).json(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        missing = counted
    else:
        held = landed.filter(F.col("bucket").isin(buckets)).groupBy(F.col("bucket").alias("_bucket"), digest.alias("_digest")).agg(F.count(F.lit(1)).alias("_held"))
        missing = counted.join(held, ["_bucket", "_digest"], "left").withColumn("_n", F.col("_n") - F.coalesce("_held", F.lit(0))).filter("_n > 0")
    copies = missing.select("_bucket", "_row", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    copies.select("_row.*", F.col("_bucket").alias("bucket")).write.mode("append").partitionBy("bucket").json(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_pairs_csv(pairs: DataFrame, folder: str) -> None:
    """``name,comment`` with a header; every value is quoted and kept as it is."""
    pairs.select("name", "comment").write.mode("overwrite").options(
        header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(folder)


def write_files(files: DataFrame, folder: str, only_changed: bool = True) -> None:
    """``(path, content)`` of the commented files to a new place: the changed ones, or
    all of them as the pass-through output."""
    rows = files.filter(~F.col("content").eqNullSafe(F.col("new_content"))) if only_changed else files
    rows.select("path", F.col("new_content").alias("content")).write.mode("errorifexists").parquet(folder)


def show(df: DataFrame, rows: int = 20) -> None:
    df.show(rows)
