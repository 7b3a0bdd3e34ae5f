"""The evaluation job: stored dataset lines to scores of every model version."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.evaluation import Model, predict_in_batches, version_scores, with_versions
from docloom.operators.ordering import row_window
from docloom.sources.files import parse_dataset_lines, rejected_rows, valid_rows
from docloom.session import stored


def evaluation_run(
    lines: DataFrame,
    order_by: Sequence[str],
    latest: int,
    load: Callable[[int], Model],
    text: str = "name",
    start: int = 0,
    length: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """(scores, rejected) of a window of dataset lines under the versions 1..latest.

    ``lines`` has the text of each line in ``value`` and its place in ``order_by``.  A line
    that is no record is rejected; a text whose model fails counts as a miss and in
    ``n_failed`` of its version.  The replies are stored, so that no model runs twice.
    """
    window = row_window(lines, order_by, start, length)
    parsed = parse_dataset_lines(window)
    replies = stored(predict_in_batches(with_versions(valid_rows(parsed), latest), load, text))
    failed = replies.groupBy("version").agg(F.count("error").alias("n_failed"))
    return version_scores(replies).join(failed, "version"), rejected_rows(parsed)
