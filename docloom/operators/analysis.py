"""Comment analysis and grading of whole tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import grading
from docloom.functions.once import with_once
from docloom.functions.grading import DEFAULT_LEXICON, Lexicon
from docloom.session import stored

#: Characters of comments that a task looks up in a lexicon table.
TASK_CHARS = 1 << 22


def graded(df: DataFrame, comment: str = "comment", lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Adds ``counts`` and ``grade``; narrow, row by row.  A missing comment is graded as an empty one."""
    counted = with_once(
        with_once(df, "_roles", grading.roles(comment, lexicon)), "counts", grading.counts("_roles")
    )
    c = F.col("counts")
    return counted.select(
        *df.columns, "counts", grading.grade(c["n_tokens"], c["n_verbs"], c["n_stop"], c["n_tech"]).alias("grade")
    )


def analyzed(df: DataFrame, comment: str = "comment", lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Adds ``comment_analysis``.  Grading needs far less work, so filter by grade first."""
    tagged = with_once(df, "_items", grading.tagged(comment, lexicon))
    return tagged.withColumn("comment_analysis", grading.analysis("_items", lexicon)).drop("_items")


def good_only(graded_rows: DataFrame) -> DataFrame:
    return graded_rows.filter(F.col("grade") == "good")


def one_entry_a_word(lexicon: DataFrame) -> DataFrame:
    """The lexicon with one row a word, of several the first by tag and lemma.

    A word that is a verb and a noun has two entries in most lexicons; joined as they are,
    they would count it twice.
    """
    entry = F.struct("pos", "lemma", "is_stop")
    first = lexicon.filter(F.col("word").isNotNull()).groupBy("word").agg(F.min(entry).alias("entry"))
    return first.select("word", "entry.lemma", "entry.pos", "entry.is_stop")


def _placed(df: DataFrame, id_columns: list[str], comment: str) -> DataFrame:
    """The comments with a key of their own, stored, so that equal or missing ids are no group.

    A task explodes its comments into words many times their size, so it is given a bounded
    number of characters whatever the size of the table.
    """
    keyed = stored(df.select(*id_columns, comment).withColumn("_row", F.monotonically_increasing_id()))
    chars = keyed.agg(F.sum(F.length(comment))).first()[0] or 0
    tasks = max(keyed.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / TASK_CHARS))
    return keyed.repartition(tasks, "_row")


def grade_with_lexicon(
    df: DataFrame, lexicon: DataFrame, id_columns: list[str], comment: str = "comment"
) -> DataFrame:
    """Counts and grade against a lexicon table, without the tokens themselves.

    The words of a comment are counted where the comment has been placed, looked up once
    each, and their counts summed; words the table lacks keep their built-in roles.  There
    is one row for each row of ``df``, whatever its ids, and one entry counts for a word.
    """
    row = ["_row", *id_columns]
    words = F.transform(grading.tokens(F.coalesce(F.col(comment), F.lit(""))), lambda t: F.lower(t))
    pairs = F.arrays_zip(words.alias("word"), grading.roles(comment).alias("role"))
    counted = (
        _placed(df, id_columns, comment).select(*row, F.explode_outer(pairs).alias("t"))
        .groupBy(*row, F.col("t.word").alias("word"), F.col("t.role").alias("role"))
        .agg(F.count("t.word").alias("n"))
    )
    known = one_entry_a_word(lexicon).select("word", F.lower("lemma").isin(*grading.TECH_TERMS).alias("_tech"), (F.col("pos") == "VERB").alias("_verb"), F.col("is_stop").alias("_stop"))
    found = counted.join(known, ["word"], "left")

    def total(flag: str, bit: int):
        own = F.col("role").bitwiseAND(F.lit(bit)) > 0
        return F.sum(F.when(F.coalesce(F.col(flag), own, F.lit(False)), F.col("n")).otherwise(0))

    summed = found.groupBy(*row).agg(
        F.sum("n").alias("n_tokens"), total("_verb", grading.IS_VERB).alias("n_verbs"),
        total("_stop", grading.IS_STOP).alias("n_stop"), total("_tech", grading.IS_TECH).alias("n_tech"),
    )
    c = [F.col(name) for name in ("n_tokens", "n_verbs", "n_stop", "n_tech")]
    return summed.withColumn("grade", grading.grade(*c)).drop("_row")


def analyze_with_lexicon(
    df: DataFrame, lexicon: DataFrame, id_columns: list[str], comment: str = "comment"
) -> DataFrame:
    """Analysis against a lexicon *table* ``(word, lemma, pos, is_stop)`` of any size.

    Tokens are exploded and looked up by word; where the lexicon is too large to
    broadcast, adaptive execution splits the partition of a frequent word.  A comment is
    put together again from its own tokens, so a group never exceeds one input row.
    Words that the table lacks keep the built-in lemma and tag.  There is one row for each
    row of ``df``, whatever its ids, and one entry counts for a word.
    """
    # Placed before the explode: with the lexicon broadcast, the comments are the only rows
    # that are shuffled, not their tokens.
    row = ["_row", *id_columns]
    rows = _placed(df, id_columns, comment).select(
        *row,
        F.posexplode_outer(grading.tagged(comment)).alias("pos_in_text", "item"),
    ).withColumn("word", F.col("item.word"))
    known = one_entry_a_word(lexicon).select(
        "word",
        F.col("lemma").alias("_lemma"), F.col("pos").alias("_pos"), F.col("is_stop").alias("_stop"),
    )
    found = rows.join(known, ["word"], "left")
    item = F.col("item")
    found = found.select(
        *row, "pos_in_text", F.col("item.text").alias("text"),
        F.coalesce("_lemma", item["lemma"]).alias("lemma"),
        F.coalesce("_pos", item["pos"]).alias("pos"),
        F.coalesce("_stop", item["word"].isin(*DEFAULT_LEXICON.stop_words), F.lit(False)).alias("is_stop"),
    )
    whole = found.groupBy(*row).agg(
        F.array_sort(
            F.collect_list(
                F.when(F.col("text").isNotNull(), F.struct("pos_in_text", "text", "lemma", "pos", "is_stop"))
            )
        ).alias("items")
    )
    items = F.col("items")
    n_tokens = F.size(items)
    n_verbs = F.size(F.filter(items, lambda x: x["pos"] == "VERB"))
    n_stop = F.size(F.filter(items, lambda x: x["is_stop"]))
    n_tech = F.size(F.filter(items, lambda x: F.lower(x["lemma"]).isin(*grading.TECH_TERMS)))
    return whole.select(
        *id_columns,
        F.transform(items, lambda x: x["text"]).alias("tokens"),
        F.transform(items, lambda x: x["lemma"]).alias("lemmas"),
        F.transform(items, lambda x: x["pos"]).alias("pos_tags"),
        n_tokens.alias("n_tokens"), n_verbs.alias("n_verbs"), n_stop.alias("n_stop"), n_tech.alias("n_tech"),
        grading.grade(n_tokens, n_verbs, n_stop, n_tech).alias("grade"),
    )
