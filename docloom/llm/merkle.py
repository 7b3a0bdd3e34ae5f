"""Merkle manifest of a dataset, with a proof for each leaf.

A tree's leaves lie in superblocks of ``ARITY ** BLOCK_LEVELS`` consecutive ones.  On the
way up every superblock is reduced to one node, and the nodes of a level are the leaves of
the next, until a tree is one node.  On the way down superblocks meet, in a cogroup, what
lies outside them on the way to the root, and finish proofs and folds by themselves.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.store import stored

ARITY = 8
#: Levels that a task reduces at once: a superblock has 512 nodes.
BLOCK_LEVELS = 3
#: Rows of one partition are numbered in the low bits of a generated id.
ROW_BITS = 33
#: The letters that tampering lowers, and what stands for a null.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NONE = "-"

PATH = "proof array<string>, slots array<int>, widths array<int>"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each as its byte count, a colon and its text, or as ``-``."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(NONE))

    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else; ``lower`` does it where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def joined_digest(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _layers(nodes: list[str], size: int, rounds: int) -> list[list[str]]:
    """The nodes of a superblock and those above them, down to one: after ``rounds`` if the
    tree, of ``size`` nodes, has other superblocks, else as soon as one is left."""
    layers = [nodes]
    while len(layers) <= rounds if size > ARITY**rounds else len(layers[-1]) > 1:
        last = layers[-1]
        layers.append([joined_digest(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return layers


def _paths(layers: list[list[str]], proof: list[str], slots: list[int], widths: list[int]) -> list[tuple[list, list, list]]:
    """For each node of the first layer: siblings from there up, own slot and width of each run."""
    paths = [(proof, slots, widths)]
    for layer in reversed(layers[:-1]):
        below = []
        for i in range(len(layer)):
            begin = i - i % ARITY
            run = layer[begin : begin + ARITY]
            up = paths[i // ARITY]
            below.append((run[: i - begin] + run[i - begin + 1 :] + up[0], [i - begin, *up[1]], [len(run), *up[2]]))
        paths = below
    return paths


def fold(digest: str, proof: list[str], slots: list[int], widths: list[int]) -> str:
    """The root that a leaf and its proof lead to."""
    at = 0
    for slot, width in zip(slots, widths, strict=True):
        beside = proof[at : at + width - 1]
        digest = joined_digest([*beside[:slot], digest, *beside[slot:]])
        at += width - 1
    return digest


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, whose column ``tree`` has no nulls, with ``position`` in the tree and its ``size``.

    Rows are sorted by range and stored with a running number; a position is the row's
    place in its partition plus what the tree has in partitions before.  The counts are
    one row a tree and partition that holds some of it.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = stored(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged").withColumn("_part", F.shiftright("_id", ROW_BITS))
    counts = stored(ranged.groupBy("tree", "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")), "counts")
    # A window holds one row a partition, whatever the leaves.
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    placed = ranged.join(sums, ["tree", "_part"]).withColumn("position", F.col("_id") - F.col("_first") + F.col("_before"))
    return placed.drop("_id", "_part", "_first", "_before")


def _climb(nodes: DataFrame, rounds: int) -> list[DataFrame]:
    """Tables (tree, position, size, node) of the leaves, of their superblocks, of those'
    superblocks and so on; in the last every tree is one node."""
    width = ARITY**rounds

    def up(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("position")
        first = block.iloc[0]
        top = _layers(block["node"].tolist(), int(first["size"]), rounds)[-1][0]
        return pd.DataFrame({"tree": [first["tree"]], "position": [first["block"]], "size": [-(-int(first["size"]) // width)], "node": [top]})

    tables = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 1
    while most > 1:
        blocks = tables[-1].select("tree", "position", "size", "node", F.floor(F.col("position") / width).alias("block"))
        tables.append(stored(blocks.groupBy("tree", "block").applyInPandas(up, "tree string, position long, size long, node string"), "blocks"))
        most = -(-most // width)
    return tables


def _descend(tables: list[DataFrame], above: DataFrame, rounds: int) -> DataFrame:
    """The first table's rows (tree, position, node, row, shown) with their paths.

    ``above`` (tree, subroot, root, proof, slots, widths) is what lies beyond each tree's
    top; ``shown`` is the digest that is folded.
    """
    width = ARITY**rounds

    def finish(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("position")
        beyond = outer.iloc[0]
        nodes, shown = block["node"].tolist(), block["shown"].tolist()
        layers = _layers(nodes, int(block["size"].iloc[0]), rounds)
        paths = _paths(layers, list(beyond["proof"]), list(beyond["slots"]), list(beyond["widths"]))
        return pd.DataFrame(
            {
                "tree": block["tree"].tolist(), "position": block["position"].tolist(), "node": nodes, "row": block["row"].tolist(),
                "subroot": beyond["subroot"], "root": beyond["root"],
                "proof": [p[0] for p in paths], "slots": [p[1] for p in paths], "widths": [p[2] for p in paths],
                "folded_root": [fold(s if s is not None else n, *p) for s, n, p in zip(shown, nodes, paths, strict=True)],
            }
        )

    schema = f"tree string, position long, node string, row string, subroot string, root string, {PATH}, folded_root string"
    outer = above.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(tables[:-1] or tables):
        rows = nodes if "row" in nodes.columns else nodes.withColumns({"row": F.lit(None).cast("string"), "shown": F.lit(None).cast("string")})
        rows = rows.select("tree", "position", "size", "node", "row", "shown", F.floor(F.col("position") / width).alias("block"))
        met = rows.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
        found = met.applyInPandas(finish, schema)
        outer = found.select("tree", F.col("position").alias("block"), "subroot", "root", "proof", "slots", "widths")
    return found


def manifest(docs: DataFrame, columns: list[str], tree: str = "lang", id_column: str = "doc_id", shown: Column | None = None, rounds: int = BLOCK_LEVELS) -> DataFrame:
    """One row for each document: id, ``leaf``, ``subroot``, ``root``, ``position``, ``proof``
    (siblings from the leaf up, left to right), ``slots`` and ``widths`` (own place in, and
    size of, the run of each level), ``folded_root`` and ``verified``.

    A leaf is the digest of ``columns``.  Each value of ``tree`` has a tree over its leaves
    by id, nulls first, then by leaf; while it has more than one node, every ``ARITY``
    consecutive ones become one, the last run may have fewer.  The subroots, by ``tree``
    with null first, make one more tree.  ``shown`` is the leaf digest that is put to the
    proof, the leaf itself where it is null; ``verified`` says that it leads to the root.

    Text is read once, for the leaves.  A hot tree is as many superblocks of
    ``ARITY ** rounds`` leaves as it needs; tasks never hold more than those and the path above.  Two readings of the
    leaf table are shuffled, digests and ids only.

    Any column may be null, and texts may be empty or of any length.  Rows equal in all
    ``columns`` are leaves of their own, which neighbour each other.  Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType
    named = F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    leaves = docs.select(
        named.alias("tree"), F.col(id_column).alias("order"), F.col(id_column).cast("string").alias("row"),
        leaf_digest([F.col(c) for c in columns]).alias("node"), (F.lit(None).cast("string") if shown is None else shown).alias("shown"),
    )
    placed = stored(numbered(stored(leaves, "leaves"), ["order", "node"]).select("tree", "position", "size", "node", "row", "shown"), "placed")
    tables = _climb(placed, rounds)
    tops = tables[-1].select(F.lit("").alias("tree"), F.col("tree").alias("row"), "node", F.lit(None).cast("string").alias("shown"))
    forest = _climb(stored(numbered(tops, ["row"]), "tops"), rounds)
    end = forest[-1].select("tree", F.col("node").alias("subroot"), F.col("node").alias("root"), *[F.array().cast(f"array<{k}>").alias(c) for c, k in (("proof", "string"), ("slots", "int"), ("widths", "int"))])
    above = _descend(forest, end, rounds).select(F.col("row").alias("tree"), F.col("node").alias("subroot"), "root", "proof", "slots", "widths")
    found = _descend(tables, stored(above, "above"), rounds)
    return found.select(
        F.col("row").cast(kind).alias(id_column), F.col("node").alias("leaf"), "subroot", "root", "position", "proof", "slots", "widths",
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
