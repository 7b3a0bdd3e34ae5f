"""Dataset rows x model versions, prediction, version scores and loss curves."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.once import let, with_once
from docloom.functions.text import words
from docloom.operators.features import IGNORED_LABEL, kept_labels
from docloom.operators.filters import split_blank_inputs
from docloom.session import stored

# Fixed value: the version an inference request gets when it names none.
DEFAULT_VERSION = 9


def inference_requests(rows: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(requests, rejected): a missing version becomes the default, an empty text is
    rejected with an ``error``."""
    version = F.coalesce(F.col("version"), F.lit(DEFAULT_VERSION))
    return split_blank_inputs(rows.withColumn("version", version), text)


def with_versions(rows: DataFrame, latest: int | Column, column: str = "version") -> DataFrame:
    """Every row once per model version 1..latest, in place (no join)."""
    last = F.lit(latest) if isinstance(latest, int) else latest
    versions = F.when(last >= 1, F.sequence(F.lit(1), last.cast("int")))
    return rows.withColumn(column, F.explode(versions))


def predict(rows: DataFrame, predictor: Callable[[Column, Column], Column], text: str = "name") -> DataFrame:
    """Adds ``predicted`` from a column expression of (text, version)."""
    return with_once(rows, "predicted", predictor(F.col(text), F.col("version")))


Model = Callable[[list[str]], list[str]]
# Models of this worker process, by the loader's digest and the version.
_LOADED: dict[tuple[str, int], Model] = {}


def _loaded(load: Callable[[int], Model], name: str, version: int) -> Model:
    # A function of the module, so that a worker's tasks share the module's own table.
    if (name, version) not in _LOADED:
        _LOADED[name, version] = load(version)
    return _LOADED[name, version]


def _replies(model: Model, texts: list[str]) -> list[tuple[str | None, str | None]]:
    """(reply, error) for each text; if the batch fails, each text is asked for by itself."""
    try:
        replies = list(model(texts))
        if len(replies) != len(texts):
            raise ValueError(f"{len(replies)} replies to {len(texts)} texts")
        return [(reply, None) for reply in replies]
    except Exception as failure:  # a model error belongs to its row
        if len(texts) == 1:
            return [(None, str(failure))]
    return [pair for text in texts for pair in _replies(model, [text])]


def predict_in_batches(rows: DataFrame, load: Callable[[int], Model], text: str = "name") -> DataFrame:
    """Adds ``predicted``, ``elapsed_ms`` and ``error`` from a Python model.

    ``load(version)`` gives a function from texts to replies; it runs once for a worker
    process and version.  The rows of an Arrow batch are asked for together, version by
    version, and share the time that took.  A text that fails costs its row only.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    name = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            predicted, errors = [None] * len(batch), [None] * len(batch)
            elapsed = [0] * len(batch)
            texts = batch[text].tolist()
            for version, places in batch.groupby("version").indices.items():
                model = _loaded(load, name, int(version))
                begun = time.monotonic()
                replies = _replies(model, [texts[k] for k in places])
                each = int((time.monotonic() - begun) * 1000 / len(places))
                for k, (reply, error) in zip(places, replies, strict=True):
                    predicted[k], errors[k], elapsed[k] = reply, error, each
            yield batch.assign(
                predicted=pd.Series(predicted, index=batch.index, dtype="object"),
                elapsed_ms=pd.Series(elapsed, index=batch.index, dtype="int64"),
                error=pd.Series(errors, index=batch.index, dtype="object"),
            )

    return rows.mapInPandas(run, f"{schema}, predicted string, elapsed_ms bigint, error string")


def word_f1(predicted: Column, expected: Column) -> Column:
    """F1 of the two sets of lower-cased words; 1 when both are empty."""
    left, right = (F.array_distinct(words(F.lower(F.coalesce(c, F.lit(""))))) for c in (predicted, expected))

    def score(sets: Column) -> Column:
        total = F.size(sets["left"]) + F.size(sets["right"])
        common = F.size(F.array_intersect(sets["left"], sets["right"]))
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common / total)

    return let(F.struct(left.alias("left"), right.alias("right")), score)


def version_scores(predictions: DataFrame, expected: str = "comment") -> DataFrame:
    """Exact-match rate and mean word F1 per version."""
    exact = F.coalesce(F.col("predicted") == F.col(expected), F.lit(False))
    scored = predictions.select(
        "version", exact.cast("int").alias("exact"), word_f1(F.col("predicted"), F.col(expected)).alias("f1")
    )
    return scored.groupBy("version").agg(
        F.count(F.lit(1)).alias("n"), F.avg("exact").alias("exact_rate"), F.avg("f1").alias("mean_f1")
    )


def _poisson_limits() -> list[int]:
    """Of 2^32 equally likely numbers, how many give at most 0, 1, 2, ... events of a mean of 1."""
    limits, share, whole = [], math.exp(-1), 0.0
    for k in range(12):
        whole += share
        limits.append(int(whole * 2**32))
        share /= k + 1
    return limits


def bootstrap_weights(ids: list[Column], replicates: int, seed: int) -> Column:
    """How often each replicate draws a row: Poisson numbers of mean 1, by hash of seed,
    replicate and ids, so that any engine draws alike."""
    name = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in ids])

    def weight(number: Column) -> Column:
        limits = _poisson_limits()
        found = F.when(number < limits[0], 0)
        for k, limit in enumerate(limits[1:], 1):
            found = found.when(number < limit, k)
        return found.otherwise(len(limits))

    # A digest has four numbers of 32 bits.
    digests = F.transform(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)), lambda k: F.md5(F.concat_ws(":", k, name)))
    parts = F.transform(digests, lambda d: F.array(*[F.conv(F.substring(d, 1 + 8 * j, 8), 16, 10).cast("long") for j in range(4)]))
    return F.transform(F.slice(F.flatten(parts), 1, replicates), weight)


def version_intervals(
    predictions: DataFrame, id_columns: list[str], expected: str = "comment", replicates: int = 200, seed: int = 2022, level: float = 0.95
) -> DataFrame:
    """Whether a version is better than the first one: ``(version, n, difference, low, high)``.

    ``difference`` is the mean of a version's word F1 less that of the least version on the
    same rows, and low and high are its limits in a bootstrap, in which a row and all its
    versions are drawn together.  All replicates are summed in one pass: a row brings its
    weights along, and the sums of a task are as many as versions times replicates.

    Scores are whole millionths, so sums do not depend on their order.  A row that lacks
    one of the two versions is not compared.  Of rows equal in ids and version the best
    counts; a failed reply scores as an empty text.
    """
    scored = predictions.select(*id_columns, "version", F.round(word_f1(F.col("predicted"), F.col(expected)) * 1e6).cast("long").alias("score"))
    first = predictions.agg(F.min("version")).first()[0]
    best = scored.groupBy(*id_columns, "version").agg(F.max("score").alias("score"))
    rows = best.groupBy(*id_columns).agg(
        F.max(F.when(F.col("version") == F.lit(first), F.col("score"))).alias("base"),
        F.collect_list(F.when(F.col("version") != F.lit(first), F.struct("version", "score"))).alias("others"),
    )
    weighed = with_once(rows.filter("base IS NOT NULL"), "weights", bootstrap_weights([F.col(c) for c in id_columns], replicates, seed))
    pairs = weighed.select("weights", F.explode("others").alias("o"), "base").select(
        F.col("o.version").alias("version"), (F.col("o.score") - F.col("base")).alias("gain"), F.posexplode("weights").alias("replicate", "weight")
    )
    sums = pairs.groupBy("version", "replicate").agg(
        F.sum(F.col("weight") * F.col("gain")).alias("drawn"), F.sum("weight").alias("size"), F.sum("gain").alias("whole"), F.count(F.lit(1)).alias("n")
    )
    per_version = sums.groupBy("version").agg(
        F.max("n").alias("n"), (F.max("whole") / F.max("n") / 1e6).alias("difference"),
        F.array_sort(F.collect_list(F.when(F.col("size") > 0, F.col("drawn") / F.col("size") / 1e6))).alias("drawn"),
    )

    def limit(share: float) -> Column:
        return F.element_at("drawn", F.ceil(F.round(F.size("drawn") * F.lit(share), 6)).cast("int"))

    return per_version.select("version", "n", "difference", limit((1 - level) / 2).alias("low"), limit((1 + level) / 2).alias("high"))


def epoch_losses(steps: DataFrame) -> DataFrame:
    """Mean loss per epoch and phase of ``(epoch, phase, step, loss)``."""
    return steps.groupBy("epoch", "phase").agg(
        F.count(F.lit(1)).alias("n_steps"), (F.sum("loss").cast("double") / F.count(F.lit(1))).alias("mean_loss")
    )


def batch_loss(token_losses: Column, labels: Column) -> Column:
    """Mean of the losses of kept labels; null for a batch without one."""
    kept = F.filter(F.zip_with(token_losses, labels, lambda x, y: F.when(y != IGNORED_LABEL, x)), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda total, x: total + x), kept_labels(labels))


def running_losses(steps: DataFrame) -> DataFrame:
    """Adds ``running_loss``, the mean loss of an epoch and phase up to each step.

    Steps are sorted into ranges of about equally many rows, however the step numbers lie;
    the sums of earlier ranges (one row a range) are added to the running sum within a
    range, so a task never holds a whole epoch.  The ranges are stored, so that all passes
    see the same ones.  A null epoch or phase is a group like any other; rows without a
    step come first.
    """
    ranged = steps.repartitionByRange("epoch", "phase", "step")
    blocked = stored(ranged.withColumn("_block", F.spark_partition_id()))
    key = ["epoch", "phase"]
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*key, "_block").agg(F.sum("loss").alias("_s"), F.count(F.lit(1)).alias("_n"))
    offsets = totals.select(
        *[F.col(c).alias(f"_{c}") for c in key], F.col("_block").alias("_own"),
        F.sum("_s").over(earlier).alias("_before"), F.sum("_n").over(earlier).alias("_count"),
    )
    inside = Window.partitionBy(*key, "_block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.withColumn("_sum", F.sum("loss").over(inside)).withColumn("_rows", F.count(F.lit(1)).over(inside))
    total = F.col("_sum") + F.coalesce("_before", F.lit(0).cast(steps.schema["loss"].dataType))
    rows = F.col("_rows") + F.coalesce("_count", F.lit(0))
    same = F.col("_block").eqNullSafe(F.col("_own"))
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (
        summed.join(offsets, same)
        .withColumn("running_loss", total.cast("double") / rows)
        .select(*steps.columns, "running_loss")
    )
