"""The comment job: files and configuration tables to commented files and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.prompts import decode_response, request_body
from docloom.functions.text import directory
from docloom.operators.config import choose_provider, resolve_configs, with_config
from docloom.operators.extract import undocumented_functions
from docloom.operators.filters import generator_files
from docloom.operators.rewrite import commented
from docloom.session import stored, tasks_for

#: Files that a task comments.
TASK_FILES = 1 << 9


def configured_files(
    files: DataFrame,
    configs: DataFrame,
    modules: DataFrame,
    local: str | None = None,
    prefixes: list[str] | None = None,
) -> DataFrame:
    """Go files with the merged configuration and provider of their directory.

    The join may bring a directory's files together, so they are dealt again by path, a
    bounded number a task, before anything reads them.
    """
    kept = generator_files(files)
    dirs = kept.select(directory(F.col("path")).alias("dir"))
    resolved = choose_provider(resolve_configs(dirs, configs, modules, local, prefixes))
    placed = with_config(kept, resolved.withColumnRenamed("signature", "author"))
    return placed.repartition(tasks_for(files.sparkSession, kept.count(), TASK_FILES), "path")


def commented_files(configured: DataFrame) -> DataFrame:
    """Template comments with the author and examples that the configuration asks for."""
    return commented(configured, signature=F.col("author"), with_example=F.col("active_examples"))


def model_requests(configured: DataFrame) -> DataFrame:
    """Request bodies for undocumented functions whose provider is a model."""
    asked = undocumented_functions(configured.filter("provider != 'template' AND config_error IS NULL"))
    body = request_body(F.col("provider"), F.col("signature"), F.col("model_version"))
    return asked.select("path", "pos", "provider", body.alias("request"))


def apply_replies(configured: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, rejected) of the folders whose provider is a model.

    ``replies`` is ``(path, pos, body)``, the answers to ``model_requests``.  A comment goes
    before its function with the author that the configuration names; types get their
    template whatever the provider, constants and variables with the local provider.
    ``rejected`` is ``(path, pos, error)``: an answer that cannot be decoded, a request
    without an answer, an answer that nothing asked for, or a file (without ``pos``) whose
    configuration is in error.  Every request and every answer is in one of the frames.  Of several answers to one request
    the least text counts.  A file's answers meet in its own row, so a group is never
    larger than a file.
    """
    asked = configured.filter("provider != 'template'")
    usable = asked.filter("config_error IS NULL")
    answers = replies.groupBy("path", "pos").agg(F.min("body").alias("body"))
    requests = undocumented_functions(usable).select("path", F.col("pos").cast("long").alias("_pos"), "provider")
    both = requests.withColumn("_asked", F.lit(True)).join(
        answers.withColumnsRenamed({"path": "_path", "pos": "_place"}), (F.col("path") == F.col("_path")) & (F.col("_pos") == F.col("_place")), "full"
    )
    both = stored(both.select(F.coalesce("path", "_path").alias("path"), F.coalesce("_place", "_pos").cast(replies.schema["pos"].dataType).alias("pos"), "provider", "body", "_asked", F.col("_path").isNotNull().alias("_answered")))
    met = both.filter("_asked AND _answered")
    decoded = met.select("path", "pos", decode_response(F.col("provider"), F.col("body")).alias("reply"))
    lost = both.filter("NOT _answered").select("path", "pos", F.lit("no answer").alias("error"))
    stray = both.filter("_asked IS NULL").select("path", "pos", F.lit("nothing was asked here").alias("error"))
    placed = decoded.filter("reply.error IS NULL").groupBy("path").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "reply.comment"))).alias("_replies")
    )
    done = commented(
        usable.join(placed, "path", "left"),
        signature=F.col("author"),
        with_example=F.col("active_examples"),
        replies=F.col("_replies"),
        draft_values=F.col("provider") == "localai",
    )
    no_pos = F.lit(None).cast(replies.schema["pos"].dataType).alias("pos")
    rejected = asked.filter("config_error IS NOT NULL").select("path", no_pos, F.col("config_error").alias("error"))
    failed = decoded.filter("reply.error IS NOT NULL").select("path", "pos", "reply.error")
    return done.drop("_replies"), rejected.unionByName(failed).unionByName(lost).unionByName(stray)
