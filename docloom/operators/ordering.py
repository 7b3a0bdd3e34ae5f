"""Positions, splits, shuffled epochs and batches without a one-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from docloom.session import checkpointed

# A range this small is finished with one bounded top-k.
SMALL_RANGE = 100_000
# Rows of one partition are numbered in the low bits of the generated id.
ROW_BITS = 33


def _tuple(order_by: Sequence[str]) -> Column:
    return F.struct(*order_by)


def _literal(key: Row, df: DataFrame, order_by: Sequence[str]) -> Column:
    return F.struct(*[F.lit(key[c]).cast(df.schema[c].dataType).alias(c) for c in order_by])


def key_at(df: DataFrame, order_by: Sequence[str], position: int) -> Row | None:
    """The order key of the row at a 0-based position, None past the end.

    ``order_by`` identifies a row and has no nulls.  Only key columns are read.  Each round range-
    partitions the keys and fetches one (count, first key) per partition, then goes on
    inside the partition that holds the position, so the driver sees a bounded summary
    and a round divides the candidates by the number of partitions.
    """
    keys = df.select(*order_by)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        summary = (
            keys.repartitionByRange(partitions, *order_by)
            .groupBy(F.spark_partition_id().alias("partition"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(_tuple(order_by)).alias("first"))
            .collect()
        )
        summary.sort(key=lambda r: r["partition"])
        for i, part in enumerate(summary):
            if position < part["n"]:
                break
            position -= part["n"]
        else:
            return None
        low = part["first"]
        keys = keys.filter((F.col(order_by[0]) >= F.lit(low[0])) & (_tuple(order_by) >= _literal(low, df, order_by)))
        if i + 1 < len(summary):
            high = summary[i + 1]["first"]
            keys = keys.filter((F.col(order_by[0]) <= F.lit(high[0])) & (_tuple(order_by) < _literal(high, df, order_by)))
        if part["n"] <= SMALL_RANGE:
            return keys.orderBy(*order_by).offset(position).limit(1).first()
        if len(summary) == 1 and partitions > 1:
            raise ValueError(f"{list(order_by)} does not identify rows: {part['n']} rows share a key")


def positional_split(
    df: DataFrame, order_by: Sequence[str], test_share: float = 0.1, column: str = "split"
) -> DataFrame:
    """Adds ``split``: the last ``ceil(test_share * n)`` rows in order are 'validation'.

    Finding the cut reads key columns only; assigning it is a comparison, so the wide
    rows are neither sorted nor shuffled.
    """
    total = df.count()
    cut = key_at(df, order_by, total - math.ceil(test_share * total))
    if cut is None:
        return df.withColumn(column, F.lit("train"))
    late = _tuple(order_by) >= _literal(cut, df, order_by)
    return df.withColumn(column, F.when(late, F.lit("validation")).otherwise(F.lit("train")))


def with_position(df: DataFrame, order_by: Sequence[str], column: str = "position") -> DataFrame:
    """Adds the 0-based position in the global order.

    The frame is sorted by range and stored once; a row's position is its place in its
    partition plus the sizes of the partitions before it (one row per partition, so the
    side that is broadcast is bounded by the partition count).
    """
    ordered = checkpointed(df.orderBy(*order_by)).withColumn("_id", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_part", F.shiftright("_id", ROW_BITS)).withColumn(
        "_row", F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(column, F.col("_row") + F.col("_offset"))
        .drop("_id", "_part", "_row", "_offset")
    )


def with_epochs(df: DataFrame, epochs: int, column: str = "epoch") -> DataFrame:
    """Every row once per epoch: the endless repeat, bounded by the epoch count."""
    return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def shuffle_key(seed: int, epoch: Column, row_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), row_id.cast("string")).cast("binary"))


def with_shuffled_position(
    df: DataFrame,
    row_id: str,
    seed: int = 2022,
    epoch: str | None = None,
    column: str = "position",
    bucket_rows: int = 100_000,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Adds the 0-based position in a seeded full shuffle, per epoch when one is named.

    Rows are ordered by a hash of (seed, epoch, id).  The leading hex digits of the hash
    cut every epoch into equal buckets; a row's position is its rank in its bucket plus
    the sizes of the buckets before it.  There are as many buckets as give each about
    ``bucket_rows`` rows at most; Spark broadcasts their offsets if they are small enough.

    Rows are counted twice besides.  ``ids`` are the ids (and epochs) of the same rows where
    they cost less than ``df``, which is then worked out once.
    """
    ids = df if ids is None else ids
    bucket_digits = max(1, math.ceil(math.log(max(1, ids.count() / bucket_rows), 16)))
    epoch_value = F.col(epoch) if epoch else F.lit(0)

    def with_bucket(rows: DataFrame) -> DataFrame:
        keys = rows.withColumn("_key", shuffle_key(seed, epoch_value, F.col(row_id)))
        return keys.withColumn("_bucket", F.substring("_key", 1, bucket_digits))

    keyed = with_bucket(df)
    groups = [epoch] if epoch else []
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        with_bucket(ids).groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(c).alias("_epoch") for c in groups], F.col("_bucket").alias("_own"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        )
    )
    same = F.col("_bucket") == F.col("_own")
    if epoch:  # a null epoch is one like any other
        same &= F.col(epoch).eqNullSafe(F.col("_epoch"))
    rank = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_key", row_id))
    return (
        keyed.withColumn("_rank", rank)
        .join(offsets, same)
        .withColumn(column, F.col("_rank") - 1 + F.col("_offset"))
        .drop("_key", "_bucket", "_rank", "_offset", "_own", "_epoch")
    )


def with_batch(df: DataFrame, size: int = 8, position: str = "position", column: str = "batch") -> DataFrame:
    return df.withColumn(column, F.floor(F.col(position) / size))


def pick_one(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    """One row by seeded hash order; always a row of the frame."""
    return df.orderBy(shuffle_key(seed, F.lit(0), F.col(row_id)), row_id).limit(1)


def row_window(df: DataFrame, order_by: Sequence[str], start: int = 0, length: int = 50) -> DataFrame:
    """Rows whose 1-based number is in ``[start, start + length]``, numbered in ``row_no``.

    A top-k of the window's rows, not a global sort; the rows before a far start are
    skipped by the key found there.
    """
    skipped = max(start - 1, 0)
    if skipped > SMALL_RANGE:
        first = key_at(df, order_by, skipped)
        if first is None:
            return df.limit(0).withColumn("row_no", F.lit(0))
        df = df.filter(_tuple(order_by) >= _literal(first, df, order_by))
    else:
        length, skipped = start + length - (1 if start else 0), 0
    head = df.orderBy(*order_by).limit(length + (1 if start else 0))
    numbered = head.withColumn("row_no", F.row_number().over(Window.orderBy(*order_by)) + skipped)
    return numbered.filter(F.col("row_no") >= start)


def random_split(df: DataFrame, row_id: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Seeded split with exactly ``ceil(test_share * n)`` validation rows, by hash order."""
    keyed = df.withColumn("_key", shuffle_key(seed, F.lit(0), F.col(row_id)))
    return positional_split(keyed, ["_key", row_id], test_share).drop("_key")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def training_plan(
    counts: DataFrame, batch_size: int = 8, epochs: int = 60, epochs_done: int = 0, warmup_share: float = 0.2
) -> DataFrame:
    """Step counts of a training run from ``(split, n)``: whole training batches, all
    validation batches, and the warm-up share of the remaining steps."""
    per_split = counts.agg(
        F.coalesce(F.sum(F.when(F.col("split") == "train", F.col("n"))), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum(F.when(F.col("split") == "validation", F.col("n"))), F.lit(0)).alias("validation_rows"),
    )
    remaining = max(epochs - epochs_done, 0)
    return (
        per_split.withColumn("train_steps", F.floor(F.col("train_rows") / batch_size))
        .withColumn("validation_steps", F.ceil(F.col("validation_rows") / batch_size))
        .withColumn("epochs", F.lit(remaining).cast("bigint"))
        .withColumn("total_steps", F.col("train_steps") * F.col("epochs"))
        .withColumn("warmup_steps", F.ceil(F.col("total_steps") * F.lit(warmup_share)))
    )
