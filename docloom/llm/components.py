"""Connected components of a link table, by stars that shrink from round to round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    above = both.filter(F.col("b") > F.col("a")).join(least, "a")
    return above.select(F.col("least").alias("a"), "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the least of them."""
    down = links.select(F.col("b").alias("node"), F.col("a").alias("low"))
    least = down.groupBy("node").agg(F.min("low").alias("least"))
    met = down.join(least, "node")
    own = least.select(F.col("least").alias("a"), F.col("node").alias("b"))
    return met.filter(F.col("low") != F.col("least")).select(F.col("least").alias("a"), F.col("low").alias("b")).union(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links`` (a, b), the root being the least node.

    Null ends and loops link nothing.  Minima meet in partial sums before a shuffle, and
    the joins are plain, so that adaptive execution may split a node with many links.
    Each round is stored; the rounds end when the links stand still.
    """
    links = links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    state = None
    while True:
        links = stored(_small_star(_large_star(links)), "stars")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return roots.union(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
