"""The document pipeline: stages in order, each over all rows its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.decontaminate import remove_contamination
from docloom.llm.language_id import UNKNOWN, held_out, predict_language, train
from docloom.llm.line_dedup import drop_repeated_lines
from docloom.llm.mixing import mix_sources
from docloom.llm.parity_join import similar_sets
from docloom.llm.store import stored

#: No source may be repeated more often, in a mix as large as what is left.
REPETITIONS = 1.5
#: Least share of the probability that a document's language must have.
SCORE = 0.5
#: Words of a shingle of the similar-documents stage, and the least similarity in hundredths.
SHINGLE_WORDS, SIMILAR = 5, 80


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
CORE = ("doc_id", "text", "lang", "source", "n_chars")


def _others_apart(stage: Stage) -> Stage:
    """The stage with columns beyond those of documents under names that nothing else uses;
    a column that the stage adds replaces one of its name."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in CORE else f"other column {i}" for i, c in enumerate(docs.columns)}
        done = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        added = [c for c in done.columns if c not in names.values()]
        return done.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items() if c not in added], *added)

    return run_stage


def _row(docs: DataFrame) -> Column:
    """A document's name in order of ids, nulls last; rows equal in all columns share it."""
    columns = [F.col(f"`{c}`") for c in docs.columns if "map<" not in dict(docs.dtypes)[c]]
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*columns, *[c.isNull() for c in columns]).alias("hash"))


def _resized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text where the text has changed."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(columns)


@_others_apart
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one language, which becomes ``lang`` where that is null.

    Those without a letter or text go, and those of which no language has ``SCORE`` of the
    probability.  If nothing was labelled, nothing is known and all documents go.
    """
    trees = train(docs.filter(~held_out("doc_id")))
    sure = predict_language(docs, trees).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SCORE))
    return sure.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


@_others_apart
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand elsewhere; those that lose every line go.

    Null, empty and blank texts have nothing to lose and stay; repeated rows lose the same lines.
    """
    kept = drop_repeated_lines(docs)
    return _resized(kept.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))), docs.columns)


@_others_apart
def similar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of similar ones; the others go.

    Null ids come last; rows equal in all columns are one document, of which one stays.
    Documents without words are similar to nothing and stay.
    """
    named = docs.withColumn("_row", _row(docs))
    groups = similar_sets(named, id_column="_row", width=SHINGLE_WORDS, least=SIMILAR)
    first = groups.filter(F.col("_row") == F.col("component_id")).select("_row").distinct()
    return named.dropDuplicates(["_row"]).join(first, "_row", "left_semi").select(docs.columns)


@_others_apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the phrases of test items; those with no word left go.

    Null texts, and texts that had no word before, stay.
    """
    columns = docs.columns
    cleaned = remove_contamination(docs.withColumn("_before", F.length("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    emptied = (F.length("text") < F.col("_before")) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _resized(cleaned.filter(~F.coalesce(emptied, F.lit(False))), columns)


@_others_apart
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is drawn, with the number of the ``copy``, its
    tokens, its source's weight, how many ``copies`` there are, and its place.

    A null source is a source.  Rows equal in all columns are one document.  Documents that
    are not drawn go, among them those without tokens unless their source is drawn whole.
    """
    named = docs.withColumn("_row", _row(docs))
    drawn = mix_sources(named, id_column="_row", repetitions=REPETITIONS).filter("copies > 0")
    drawn = drawn.select("_row", "n_tokens", "weight", "copies", "position").dropDuplicates(["_row"])
    mix = named.dropDuplicates(["_row"]).join(drawn, "_row")
    return mix.select(*docs.columns, "n_tokens", "weight", "copies", "position", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


STAGES = [
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("similar documents", similar_documents),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Learned statistics, chunk boundaries and sketches cannot be said in SQL; tests/llm
#: holds the result against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
