"""Computing a value once.

Catalyst inlines a column into every place that mentions it when it merges
projections, pushes predicates down or evaluates a lambda.  For an expensive value
``let`` and ``with_once`` stop that.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value bound to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` through a one-row generator, which predicates do not pass."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def built_once(build: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Remembers ``build(column)`` of plain column names for the running session.

    A large expression takes hundreds of round trips to the JVM to build.  It is a value,
    not bound to a frame, so one will do for every plan that mentions it.
    """
    known: dict[tuple[SparkContext, str], Column] = {}

    @wraps(build)
    def remembered(column: Column) -> Column:
        name = repr(column)
        if not re.fullmatch(r"Column<'\w+'>", name):
            return build(column)
        key = (SparkSession.active().sparkContext, name)
        if key not in known:
            known[key] = build(column)
        return known[key]

    return remembered
