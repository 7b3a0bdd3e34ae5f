"""Whitening of embedding vectors with MLlib's block matrices.

Rows get consecutive numbers, are centred and dealt into blocks of a ``BlockMatrix``.  Its
transpose times itself is the scatter matrix, whose eigenvectors are worked out on the
driver (a square of the dimensions); the blocks times the whitening matrix project the rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.store import stored

COMPONENTS = 8
#: Rows of a block at least; and blocks at most, since the driver plans a product by their
#: coordinates.
BLOCK_ROWS, MOST_BLOCKS = 1024, 100_000
#: Columns of a block at most.
BLOCK_COLUMNS = 1024
#: Blocks of the inner dimension that a task multiplies and adds up.
BLOCKS_A_SPLIT = 4
#: Components below this share of the variance are rounding errors and are left out.
NOISE = 1e-12
#: How vectors become whole numbers.
SCALE, SHIFT = 1024, 100_000


def fixed_point(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The rows with a vector of finite entries only, which become ``floor(scale * c) + shift``."""
    finite = F.forall(column, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    fixed = F.transform(column, lambda c: F.floor(c.cast("double") * scale) + shift)
    return vectors.withColumn(column, F.when(finite, fixed)).filter(F.col(column).isNotNull())


def _indexed(rows: DataFrame) -> DataFrame:
    """``rows``, stored, with consecutive ``index``: the place in a partition, plus the rows
    of those before it (one count a partition)."""
    held = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "vectors").withColumn("_part", F.shiftright("_id", 33))
    counts = stored(held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")), "counts")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return held.join(before, "_part").withColumn("index", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_part", "_first", "_before")


def _sums(rows: DataFrame, dimensions: int) -> list[int]:
    """The exact sum of each dimension."""
    parts = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    found = {r["at"]: int(r["s"]) for r in parts.collect()}
    return [found[d] for d in range(dimensions)]


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left * right, the inner dimension dealt over ``splits`` tasks that each send on one sum.

    The same method of the Python class leaves out this argument and would bring all blocks
    that meet in one result block into one task.
    """
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def whiten(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector: id, ``n``, ``deviation``, ``whitened`` (an array, the component of
    most variance first), ``explained`` (its shares of the variance) and ``identity_error``.

    ``column`` holds arrays of whole numbers.  Mean and covariance are those of all vectors,
    the divisor is their number.  ``deviation`` is the exact sum over dimensions of
    (n * x - S) ** 2 as decimal(38,0).  ``identity_error`` is the largest absolute entry of
    the covariance of ``whitened`` less the identity.

    Vectors of another length than the commonest (the shortest of several) are of another
    space and are left out, as are null and empty ones.  Components without variance are
    left out; the arrays may be shorter than ``components``, and empty if all vectors are
    equal.  Repeated rows, equal ids and null ids are rows of their own; an empty table
    gives no rows.  Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).alias("x")).filter("size(x) > 0")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        held = rows.withColumns({"n": F.lit(0).cast("long"), "deviation": F.lit(0).cast("decimal(38,0)"), "w": F.array().cast("array<double>")})
        return _named(held, id_column, [], 0.0)
    d, n = common["d"], common["count"]
    indexed = stored(_indexed(rows.filter(F.size("x") == d)), "indexed")
    sums = _sums(indexed, d)
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = indexed.select("index", array_to_vector(F.zip_with("x", mean, lambda x, m: x - m)).alias("vector"))
    per_block = max(BLOCK_ROWS, math.ceil(n / MOST_BLOCKS))
    width = min(d, BLOCK_COLUMNS)
    blocks = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), n, d).toBlockMatrix(per_block, width)
    splits = max(1, math.ceil(n / per_block / BLOCKS_A_SPLIT))
    scatter = _product(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()
    values, axes = np.linalg.eigh((scatter + scatter.T) / 2 / n)
    values, axes, trace = values[::-1], axes[:, ::-1], float(np.trace(scatter)) / n
    k = int(np.count_nonzero(values[:components] > NOISE * trace)) if trace > 0 else 0
    exact = F.aggregate(
        F.zip_with("x", F.array(*[F.lit(s) for s in sums]), lambda x, s: (x * n - s).cast("decimal(19,0)")),
        F.lit(0).cast("decimal(38,0)"), lambda total, y: (total + (y * y).cast("decimal(38,0)")).cast("decimal(38,0)"),
    )
    facts = indexed.select("index", "id", F.lit(n).cast("long").alias("n"), exact.alias("deviation"))
    if not k:
        return _named(facts.withColumn("w", F.array().cast("array<double>")), id_column, [], 0.0)
    matrix = axes[:, :k] / np.sqrt(values[:k])
    parts = [((i, 0), DenseMatrix(len(m), k, m.flatten("F").tolist())) for i, m in enumerate(np.split(matrix, range(width, d, width)))]
    projected = _product(blocks, BlockMatrix(spark.sparkContext.parallelize(parts, 1), width, k, d, k), 1).toIndexedRowMatrix()
    # The rows of the result as a frame, without a detour through Python.
    frame = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    white = stored(facts.join(frame.select("index", vector_to_array("vector").alias("w")), "index"), "whitened")
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    found = white.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    error = max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    return _named(white, id_column, [float(v / trace) for v in values[:k]], float(error))


def _named(rows: DataFrame, id_column: str, explained: list[float], error: float) -> DataFrame:
    shares = F.array(*[F.lit(e) for e in explained]).cast("array<double>")
    return rows.select(F.col("id").alias(id_column), "n", "deviation", F.col("w").alias("whitened"), shares.alias("explained"), F.lit(error).alias("identity_error"))
