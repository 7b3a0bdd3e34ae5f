"""Row filters of the corpus jobs; each is a plain predicate that Catalyst can move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.golang import parses, unread
from docloom.functions.text import base_name

# Words that disqualify a comment, tested without regard to case.
IGNORED_KEYWORDS = ("fixme", "note", "go:embed", "todo", "bug", "deprecated")
# Annotations that disqualify a comment, tested as written.
IGNORED_ANNOTATIONS = ("FIXME", "NOTE", "go:embed", "TODO", "BUG", "deprecated")


def in_vendor(path: Column) -> Column:
    """Whether a part of the path is exactly ``vendor``; the path is relative to the root."""
    return F.array_contains(F.split(path, "/"), "vendor")


def corpus_files(files: DataFrame) -> DataFrame:
    """Go files for the dataset: no tests, examples or vendored code."""
    path = F.col("path")
    return files.filter(
        path.endswith(".go") & ~path.endswith("_test.go") & ~path.endswith("_example.go") & ~in_vendor(path)
    )


def generator_files(files: DataFrame) -> DataFrame:
    """Go files for the comment generator: no tests, dot-files or vendor folders.

    Example files stay in.  A file named ``vendor`` is not a folder, but would not
    end in ``.go`` either.
    """
    path = F.col("path")
    return files.filter(
        path.endswith(".go") & ~path.endswith("_test.go") & ~base_name(path).startswith(".") & ~in_vendor(path)
    )


def parsable(files: DataFrame) -> DataFrame:
    return files.filter(F.coalesce(parses(F.col("content")), F.lit(False)))


def unparsable(files: DataFrame) -> DataFrame:
    """The files that are not read whole, kept aside for inspection: those that do not
    parse, and those with declarations that were not recognised."""
    content = F.col("content")
    # The parsing is only done for what looks like Go at all.
    lost = F.when(F.coalesce(parses(content), F.lit(False)), unread(content)).otherwise(True)
    return files.filter(lost)


def is_entry_point(name: Column) -> Column:
    return name.isin("main", "init")


def has_ignored_keyword(comment: Column) -> Column:
    return F.lower(comment).rlike("|".join(IGNORED_KEYWORDS))


def has_ignored_annotation(comment: Column) -> Column:
    return comment.rlike("|".join(IGNORED_ANNOTATIONS))


def changed(files: DataFrame) -> DataFrame:
    """Rows whose ``new_content`` differs from ``content``."""
    return files.filter(~F.col("content").eqNullSafe(F.col("new_content")))


def split_blank_inputs(requests: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) inference requests; a missing or empty text is rejected."""
    empty = F.coalesce(F.col(column), F.lit("")) == ""
    return requests.filter(~empty), requests.filter(empty).withColumn("error", F.lit("text is required"))
