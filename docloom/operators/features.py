"""Model inputs, a corpus vocabulary and encoded features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.grading import TOKEN
from docloom.operators.ordering import with_position
from docloom.session import stored

# Special ids of the encoding and the id that the loss ignores.
PAD_ID, BEGIN_ID, END_ID, UNKNOWN_ID, FIRST_TOKEN_ID = 0, 1, 2, 3, 4
IGNORED_LABEL = -100
# Sequence lengths of the model.
MAX_INPUT_LENGTH = 48
MAX_TARGET_LENGTH = 128


def model_input(file_name: Column, name: Column) -> Column:
    """A missing part is left out."""
    return F.concat_ws(" ", file_name, name)


def model_target(comment: Column, pos_tags: Column) -> Column:
    """``comment POS: ['NOUN', 'VERB']``."""
    quoted = F.transform(pos_tags, lambda tag: F.concat(F.lit("'"), tag, F.lit("'")))
    tags = F.coalesce(F.array_join(quoted, ", "), F.lit(""))
    return F.concat(F.coalesce(comment, F.lit("")), F.lit(" POS: ["), tags, F.lit("]"))


def with_model_text(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("input", model_input(F.col("file_name"), F.col("name"))).withColumn(
        "target", model_target(F.col("comment"), F.col("comment_analysis.pos_tags"))
    )


def encoder_tokens(text: Column) -> Column:
    """Tokens of a text; a missing text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def head(text: Column, count: int) -> Column:
    """What holds the first ``count`` tokens, without cutting up the rest of a long text."""
    return F.regexp_extract(text, rf"\A(?:[^\S\n]*+(?:{TOKEN})){{0,{count}}}+", 0)


def first_tokens(text: Column, count: int) -> Column:
    return encoder_tokens(head(text, count))


def build_vocabulary(texts: DataFrame, columns: list[str], size: int | None = None) -> DataFrame:
    """``(token, token_id, n)`` of all tokens by frequency, ties by token.

    Counting combines before the shuffle, so frequent tokens cost one row per task, and
    the ids come from a sort by range, not from one task.  ``size``, if the caller names
    one, is the width of the model's embedding table, special ids included; rarer tokens
    are then unknown.  The result is stored: every encoding run reads it, none counts
    again, and Spark knows from its size whether to broadcast it.
    """
    all_tokens = F.concat(*[encoder_tokens(F.col(c)) for c in columns])
    counts = texts.select(F.explode(all_tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_position(counts.withColumn("_rank", -F.col("n")), ["_rank", "token"], "_place")
    token_id = (F.col("_place") + FIRST_TOKEN_ID).cast("int").alias("token_id")
    kept = ranked if size is None else ranked.filter(F.col("_place") < size - FIRST_TOKEN_ID)
    return stored(kept.select("token", token_id, "n"))


def _padded(ids: Column, length: int) -> Column:
    framed = F.concat(F.array(F.lit(BEGIN_ID)), ids, F.array(F.lit(END_ID)))
    return F.slice(F.concat(framed, F.array_repeat(F.lit(PAD_ID), length)), 1, length)


def encode(
    rows: DataFrame,
    row_id: str,
    vocabulary: DataFrame,
    input_column: str = "input",
    target_column: str = "target",
    max_input: int = MAX_INPUT_LENGTH,
    max_target: int = MAX_TARGET_LENGTH,
) -> DataFrame:
    """``(row_id, input_ids, attention_mask, labels)``, all of fixed length.

    Texts are cut to the model's lengths first, as the model's own encoder does, so a
    row explodes into at most ``max_input + max_target`` tokens.  The rows are placed by
    id before they are exploded; where Spark finds the vocabulary small enough to
    broadcast, putting a row together again needs no second shuffle.

    Rows may share an id, or have none: tokens are told apart by id and texts, and rows
    equal in all of these are encoded once and given back as often as they came.
    """

    def side(column: str, start: int) -> Column:
        return F.transform(encoder_tokens(F.col(column)), lambda t, i: F.struct((i + start).alias("at"), t.alias("token")))

    # Place -1 marks the row, places below max_input are the input's, the others the target's.
    mark = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("token")))
    both = F.concat(mark, side("_input", 0), side("_target", max_input))
    heads = [head(F.col(input_column), max_input - 2).alias("_input"), head(F.col(target_column), max_target - 2).alias("_target")]
    twins = [F.xxhash64(F.lit(n), F.col(input_column), F.lit(0), F.col(target_column)).alias(f"_twin{n}") for n in (1, 2)]
    # The beginnings of the texts are placed as they stand, a fraction of their tokens with places.
    placed = rows.select(row_id, *twins, *heads).repartition(row_id)
    pieces = placed.select(row_id, "_twin1", "_twin2", F.explode(both).alias("part"))
    pieces = pieces.select(row_id, "_twin1", "_twin2", "part.at", "part.token")
    found = pieces.join(vocabulary.select("token", "token_id"), ["token"], "left")
    item = F.struct("at", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("token_id"))
    whole = found.groupBy(row_id, "_twin1", "_twin2").agg(F.collect_list(item).alias("all"))
    whole = whole.select(
        row_id,
        F.array_sort(F.array_distinct(F.filter("all", lambda x: x["at"] >= 0))).alias("items"),
        F.explode(F.filter("all", lambda x: x["at"] < 0)).alias("_row"),
    )

    def ids(of_side, length: int) -> Column:
        return _padded(F.transform(F.filter("items", of_side), lambda x: x["token_id"]), length)

    encoded = whole.select(
        row_id,
        ids(lambda x: x["at"] < max_input, max_input).alias("input_ids"),
        ids(lambda x: x["at"] >= max_input, max_target).alias("target_ids"),
    )
    return encoded.select(
        row_id, "input_ids",
        F.transform("input_ids", lambda x: F.when(x == PAD_ID, 0).otherwise(1)).alias("attention_mask"),
        F.transform("target_ids", lambda x: F.when(x == PAD_ID, IGNORED_LABEL).otherwise(x)).alias("labels"),
    )


def kept_labels(labels: Column) -> Column:
    """Number of labels the loss looks at."""
    return F.size(F.filter(labels, lambda x: x != IGNORED_LABEL))


def label_counts(batched: DataFrame, batch: str = "batch") -> DataFrame:
    return batched.groupBy(batch).agg(F.sum(kept_labels(F.col("labels"))).alias("n_labels"))
