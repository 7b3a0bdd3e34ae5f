"""Exact dedup by progressive refinement: length, then a hash of the beginning, then of the whole.

Each step looks only at rows that are not alone after the step before.  What moves between
tasks are counts of groups, and at last the rows of groups that hold copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import stored

#: The characters that do not count, space, tab, line feed, vertical tab,
#: form feed and carriage return.
BLANKS = " \t\n\v\f\r"
#: Characters of the beginning that is hashed.
BEGINNING = 64
#: Bits for each group of a table of flags, and its bounds: at most 2^20 rows of 64 bits
#: are broadcast, whatever the data.
BITS_A_GROUP, LEAST_BITS, MOST_BITS = 16, 1 << 10, 1 << 26
#: The columns that are added.
RESULT = ("keep_id", "group_size", "kept", "digest")


def normalised(text: Column) -> Column:
    """The text without blanks; no text is an empty one."""
    whole = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        whole = F.replace(whole, F.lit(blank), F.lit(""))
    return whole


def _flagged(rows: DataFrame, groups: DataFrame, by: list[str], column: str) -> DataFrame:
    """``rows`` with a boolean ``column``: false only if no row of ``groups`` agrees in ``by``.

    The groups set bits of a table whose size follows their number up to a fixed bound, so
    it can be broadcast.  A bit that two groups share lets a row pass that is alone: it is
    looked at once more by the next step, and the result is the same.
    """
    bits = LEAST_BITS
    n = groups.count()
    while bits < min(BITS_A_GROUP * n, MOST_BITS):
        bits *= 2
    bit = F.pmod(F.xxhash64(*by), F.lit(bits))
    word, place = F.shiftright(bit, 6).alias("_word"), (bit % 64).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    flags = stored(groups.groupBy(word).agg(F.bit_or(mask).alias("_mask")), "flags")
    met = rows.withColumn("_word", word).withColumn("_place", place).join(F.broadcast(flags), "_word", "left")
    return met.withColumn(column, F.coalesce(F.getbit("_mask", F.col("_place")) == 1, F.lit(False))).drop("_word", "_place", "_mask")


def copies(rows: DataFrame) -> DataFrame:
    """Groups of two or more equal texts among ``rows`` (id, text, norm): size, beginning,
    digest, group_size and first, the row that stays.  Counts meet before a shuffle."""
    sized = rows.withColumn("size", F.octet_length("norm"))
    sizes = stored(sized.groupBy("size").count().filter("count > 1"), "sizes")
    begun = _flagged(sized, sizes, ["size"], "more").filter("more").withColumn("beginning", F.xxhash64(F.substring("norm", 1, BEGINNING)))
    beginnings = stored(begun.groupBy("size", "beginning").count().filter("count > 1"), "beginnings")
    left = _flagged(begun, beginnings, ["size", "beginning"], "again").filter("again")
    first = F.min(F.struct((-F.length("text")).alias("n"), F.col("id").isNull().alias("none"), "id")).alias("first")
    whole = left.withColumn("digest", F.sha2("norm", 256)).groupBy("size", "beginning", "digest")
    return stored(whole.agg(F.count(F.lit(1)).alias("group_size"), first).filter("group_size > 1"), "copies")


def exact_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents, all columns kept, with ``keep_id``, ``group_size``, ``kept``, ``digest``.

    Texts are equal if they are after all blanks have gone; ``digest`` is the SHA-256 of
    what is left.  Of equal texts the row with the most characters stays, then the one
    with the least id, nulls last; ``keep_id`` is its id and ``group_size`` counts the rows.

    Rows alone in their length, or in their length and beginning, are never hashed as a
    whole by the search and never shuffled (their digest is worked out on the way out, if
    the caller reads it).  A group of copies meets its one row of ``copies`` in a plain
    equi-join that adaptive execution may split.

    A null text is an empty one.  Repeated rows, equal in id and in characters of equal
    texts, are one document: they share ``kept``, and each counts in ``group_size``.
    Columns of the result's names are replaced; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in RESULT]
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    id_, whole = F.col(f"c{names.index(id_column)}"), F.col(f"c{names.index(text)}")
    rows = held.withColumns({"id": id_, "text": F.coalesce(whole, F.lit("")), "norm": normalised(whole)})
    groups = copies(rows.select("id", "text", "norm"))
    keyed = rows.withColumns({"size": F.octet_length("norm"), "beginning": F.xxhash64(F.substring("norm", 1, BEGINNING)), "n": F.length("text")})
    keyed = _flagged(keyed, groups, ["size", "beginning"], "again").withColumn("digest", F.sha2("norm", 256)).drop("text", "norm")
    alone = keyed.filter(~F.col("again")).withColumns({"group_size": F.lit(None).cast("long"), "first": F.lit(None).cast(groups.schema["first"].dataType)})
    met = keyed.filter("again").join(groups.select("digest", "group_size", "first"), "digest", "left")
    both = met.unionByName(alone)
    single = F.col("first").isNull()
    stays = single | ((F.col("n") == -F.col("first.n")) & F.col("id").eqNullSafe(F.col("first.id")))
    return both.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
        F.when(single, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        stays.alias("kept"), "digest",
    )
