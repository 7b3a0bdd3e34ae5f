"""Web archives: one record per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What stands between two records of any 1.x version.
RECORD_BREAK = "\r\n\r\nWARC/1."


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(rec_type, url, payload)`` of the records under a path.

    What stands between records is the reader's line separator, so plain files split
    across tasks; a payload that holds those very bytes would be cut there, and its record
    is then shorter than its ``Content-Length`` says (``cut_short``).  Files compressed by
    member are read through the Hadoop codec, one task each.

    The line reader misses a separator that follows line breaks of the payload where its
    buffer ends between them (every 64 KB of a split), so its pieces are split once more.
    Where a *split* ends at such a place the reader gives the record behind the next
    separator twice; ``warc_source.read_archives`` has no such places.
    """
    pieces = spark.read.option("lineSep", RECORD_BREAK).text(path)
    return parse_records(pieces.select(F.explode(F.split("value", RECORD_BREAK.replace(".", r"\."))).alias("value")))


def parse_records(records: DataFrame, value: str = "value") -> DataFrame:
    """Splits record texts into headers and payload; pieces that are no record drop out.

    The block ends where ``Content-Length`` says, in bytes; without it, before the two
    line breaks that close a record.  Line breaks of the payload itself stay.  The payload
    of an HTTP message is its body.
    """
    others = [c for c in records.columns if c != value]

    def header(name: str):
        return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)

    stated = header("Content-Length").try_cast("int")
    block = F.when(stated.isNull(), F.regexp_replace("rest", r"\r\n\r\n\z", "")).otherwise(
        F.substring(F.col("rest").cast("binary"), F.lit(1), stated).cast("string")
    )
    parts = (
        records.withColumn("head", F.substring_index(F.regexp_replace(value, r"\A(?:WARC/1\.)?\d+\r\n", ""), "\r\n\r\n", 1))
        .withColumn("rest", F.substr(F.col(value), F.instr(value, "\r\n\r\n") + 4))
        .withColumn("cut_short", F.coalesce(F.octet_length("rest") < stated, F.lit(False)))
        .withColumn("rest", block)
    )
    is_http = F.col("rest").startswith("HTTP/")
    message = F.substring_index("rest", "\r\n\r\n", 1)
    body = F.substr(F.col("rest"), F.length(message) + 5)
    return parts.select(
        *others,
        header("WARC-Type").alias("rec_type"),
        header("WARC-Target-URI").alias("url"),
        F.when(is_http, body).otherwise(F.col("rest")).alias("payload"),
        "cut_short",
    ).filter(F.col("rec_type") != "")


def responses(records: DataFrame) -> DataFrame:
    return records.filter(F.col("rec_type") == "response")


def read_archive_table(spark: SparkSession, path: str, source_format: str = "avro") -> DataFrame:
    """An archive already landed as a table, in any format on the classpath."""
    return spark.read.format(source_format).load(path)
