"""The dataset job: files to graded (signature, comment) rows.

Scan, path filters, extraction, keyword filters, grading and the stored layout are one
narrow plan; nothing is shuffled before the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import file_stem
from docloom.operators.analysis import analyzed, good_only, graded
from docloom.operators.extract import function_pairs
from docloom.operators.filters import corpus_files


def graded_pairs(files: DataFrame) -> DataFrame:
    return graded(function_pairs(corpus_files(files))).withColumn("file_name", file_stem(F.col("path")))


def dataset(files: DataFrame) -> DataFrame:
    """The rows graded 'good', with their analysis."""
    return analyzed(good_only(graded_pairs(files)))
