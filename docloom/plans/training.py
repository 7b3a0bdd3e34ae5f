"""The training-set job: dataset rows to encoded, shuffled and batched training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from docloom.operators.features import build_vocabulary, encode
from docloom.operators.ordering import positional_split, with_batch, with_epochs, with_shuffled_position


def split_texts(rows: DataFrame, order_by: Sequence[str], test_share: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, vocabulary) of rows with ``input`` and ``target``.

    The rows are split once, by position; the vocabulary comes from the training rows.
    """
    split = positional_split(rows, order_by, test_share)
    train, validation = split.filter("split = 'train'"), split.filter("split = 'validation'")
    return train, validation, build_vocabulary(train, ["input", "target"])


def training_batches(
    train: DataFrame, row_id: str, vocabulary: DataFrame, epochs: int = 1, batch_size: int = 8, seed: int = 2022
) -> DataFrame:
    """``(epoch, position, batch, row_id, input_ids, attention_mask, labels)``.

    Rows are encoded once; the epochs share the features, each in a shuffled order of its
    own, so that batches hold what a trainer needs without another join.  Positions are
    counted on the ids of the training rows, not on their features.
    """
    encoded = with_epochs(encode(train, row_id, vocabulary), epochs)
    ids = with_epochs(train.select(row_id), epochs)
    shuffled = with_shuffled_position(encoded, row_id, seed, epoch="epoch", ids=ids)
    return with_batch(shuffled, batch_size)
