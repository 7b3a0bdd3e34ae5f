"""The tabular classifier recipe: split, fit, save."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame

from docloom.operators.ordering import random_split


def split_target(df: DataFrame, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """(features, target): the frame without its target column, and that column."""
    return df.drop(target), df.select(target)


def fit_forest(
    df: DataFrame, features: str, label: str, row_id: str, trees: int = 20, seed: int = 42
) -> tuple[PipelineModel, DataFrame]:
    """A random forest fitted on 80% of the rows, and its predictions for the others."""
    ready = random_split(df, row_id, 0.2, seed).select(
        row_id, "split", array_to_vector(features).alias("features"), df[label].cast("double").alias("label")
    )
    forest = RandomForestClassifier(numTrees=trees, seed=seed)
    model = Pipeline(stages=[forest]).fit(ready.filter("split = 'train'"))
    return model, model.transform(ready.filter("split = 'validation'"))


def save_model(model: PipelineModel, folder: str) -> None:
    model.write().overwrite().save(folder)
