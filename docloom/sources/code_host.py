"""Landed answers of a code host: repositories, listings and blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import decode_blob

SEARCH_SCHEMA = (
    "items array<struct<name: string, owner: struct<login: string>, language: string, stargazers_count: bigint>>"
)
CONTENTS_SCHEMA = "array<struct<name: string, path: string>>"
TREE_SCHEMA = "tree array<struct<path: string>>"
BLOB_SCHEMA = "encoding string, content string"


def read_search(spark: SparkSession, path: str) -> DataFrame:
    """``(owner, repo, language, stars)`` of stored search answers, one document per file."""
    items = spark.read.schema(SEARCH_SCHEMA).option("multiLine", True).json(path).select(F.explode("items").alias("i"))
    return items.select(
        F.col("i.owner.login").alias("owner"), F.col("i.name").alias("repo"), "i.language",
        F.col("i.stargazers_count").alias("stars"),
    )


def top_repositories(repos: DataFrame, language: str = "go", page: int = 1, per_page: int = 10) -> DataFrame:
    """One result page by stars, ties by name: a top-k of ``page * per_page`` rows."""
    return (
        repos.filter(F.lower("language") == language.lower())
        .orderBy(F.desc("stars"), "owner", "repo")
        .offset((page - 1) * per_page)
        .limit(per_page)
    )


def contents_listing(answers: DataFrame, body: str = "body") -> DataFrame:
    """One-level listings ``[{name, path}]`` to rows, ``.go`` names only."""
    others = [c for c in answers.columns if c != body]
    rows = answers.select(*others, F.explode(F.from_json(body, CONTENTS_SCHEMA)).alias("f"))
    return rows.select(*others, "f.name", "f.path").filter(F.col("name").endswith(".go"))


def tree_listing(answers: DataFrame, body: str = "body") -> DataFrame:
    """Recursive listings ``{tree: [{path}]}`` to rows, ``.go`` paths only."""
    others = [c for c in answers.columns if c != body]
    rows = answers.select(*others, F.explode(F.from_json(body, TREE_SCHEMA)["tree"]).alias("f"))
    return rows.select(*others, "f.path").filter(F.col("path").endswith(".go"))


def blobs(answers: DataFrame, body: str = "body") -> DataFrame:
    """Blob answers to ``content``; null for an encoding other than base64."""
    others = [c for c in answers.columns if c != body]
    blob = F.from_json(body, BLOB_SCHEMA)
    return answers.select(*others, decode_blob(blob["encoding"], blob["content"]).alias("content"))


def repository_files(repos: DataFrame, listing_answers: DataFrame, blob_answers: DataFrame) -> DataFrame:
    """Go files of the given repositories: ``(owner, repo, path, content)``; a file whose
    blob cannot be decoded drops out.

    ``repos`` may be one result page or many: Spark broadcasts it if it is small, else
    splits the partition of a repository that holds most of the listing.  Answers of other
    repositories go before any JSON is read.  The second join is by file, unique on both
    sides.
    """
    page = repos.select("owner", "repo")
    listed = contents_listing(listing_answers.join(page, ["owner", "repo"], "left_semi"))
    stored = blobs(blob_answers.join(page, ["owner", "repo"], "left_semi"))
    return (
        listed.join(stored, ["owner", "repo", "path"])
        .filter(F.col("content").isNotNull())
        .select("owner", "repo", "path", "content")
    )
