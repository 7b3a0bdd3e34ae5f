"""Temperature mixing of sources, and a schedule of document copies that realises it.

A source's weight is its share of all tokens to the power of an exponent, normalised.
Exponent 1 keeps the shares, 0 makes all sources equal.  The exponent is searched so that
the mix has a wanted entropy, or no source is repeated more often than a limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docloom.llm.store import stored

#: Exponents tried in one aggregation, and how often the best gap is searched again:
#: the exponent is found to 1 part in STEPS ** ROUNDS.
STEPS, ROUNDS = 32, 6
#: Tokens of a block on average: the unit that is drawn whole.
BLOCK_TOKENS = 1_000_000


def source_tokens(docs: DataFrame) -> DataFrame:
    """(source, n): tokens of each source; partial sums meet before the shuffle."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).filter("n > 0")


def _measures(totals: DataFrame, exponents: list[float], whole: int, budget: int) -> list[tuple[float, float]]:
    """For each exponent, the entropy in bits of the mix and the most repeated source's repetitions."""
    share = F.col("n") / F.lit(float(whole))
    columns = []
    for k, e in enumerate(exponents):
        power = F.pow(share, F.lit(e))
        columns += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log2(share)).alias(f"l{k}"), F.max(power / F.col("n")).alias(f"m{k}")]
    row = totals.agg(*columns).first()
    out = []
    for k, e in enumerate(exponents):
        z = row[f"z{k}"]
        # H = log z - e * E[log share] under the mix.
        from math import log2

        out.append((log2(z) - e * row[f"l{k}"] / z, row[f"m{k}"] * budget / z))
    return out


def find_exponent(totals: DataFrame, budget: int | None = None, entropy: float | None = None, repetitions: float | None = None) -> float:
    """The exponent between 0 and 1 that meets the target.

    ``entropy``: bits of the mix; the entropy falls as the exponent grows, so the gap
    that holds the target is cut again and again.  ``repetitions``: the smallest exponent,
    so the flattest mix, that repeats no source more often.  A target beyond what the
    exponents give is met as nearly as they can.  Sources never reach the driver: each
    round is one aggregation over all of them.
    """
    if (entropy is None) == (repetitions is None):
        raise ValueError("one target: entropy or repetitions")
    whole = totals.agg(F.sum("n")).first()[0]
    if not whole:
        return 1.0
    budget = whole if budget is None else budget
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        tried = [low + (high - low) * k / STEPS for k in range(STEPS + 1)]
        measured = _measures(totals, tried, whole, budget)
        # True on the flat side, where the mix is not yet concentrated enough.
        flat = [h > entropy if entropy is not None else m > repetitions for h, m in measured]
        if not flat[0]:
            return tried[0]
        if flat[-1]:
            return tried[-1]
        at = flat.index(False)
        low, high = tried[at - 1], tried[at]
    return high


def mixture(totals: DataFrame, exponent: float, budget: int) -> DataFrame:
    """(source, n, weight, budget): each source's part of the token budget."""
    whole = F.lit(float(totals.agg(F.sum("n")).first()[0] or 1))
    power = F.pow(F.col("n") / whole, F.lit(exponent))
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    weighed = totals.withColumn("weight", power / F.lit(z))
    return weighed.withColumn("budget", F.round(F.col("weight") * F.lit(float(budget))).cast("long"))


def schedule(docs: DataFrame, mix: DataFrame, seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` (key, source, n_tokens) with ``copies``, ``weight`` and ``position``.

    A source whose budget is q times its tokens and a rest is drawn q times whole, and
    the rest is the beginning of one more permutation.  A permutation orders blocks of
    about ``block_tokens`` tokens by hash, and a block's documents by hash: so a hot
    source is ordered in as many tasks as it has blocks.  The rest ends with the document
    that reaches the budget.  ``position`` (0 to 1) is a document's place in that last
    permutation, by tokens.

    A document without tokens fills no budget and has no place: it is drawn as often as
    its source is drawn whole, and never enters a block, so a block has no more documents
    than tokens.
    """
    weighed = docs.join(mix.select("source", "weight", "budget", "n"), "source", "left")
    blocked = weighed.filter("n_tokens > 0")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_tokens))).cast("long")
    draw = F.xxhash64(F.lit(seed), "key")
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), blocks)).withColumn("draw", draw)
    sums = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("held"))
    # Blocks of a source are ordered in two steps: blocks by group, groups by a running sum.
    ordered = sums.withColumn("order", F.xxhash64(F.lit(seed), "source", "block"))
    ordered = ordered.withColumn("group", F.shiftrightunsigned(F.col("order"), 52))
    groups = ordered.groupBy("source", "group").agg(F.sum("held").alias("group_held"))
    across = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("group_before", F.coalesce(F.sum("group_held").over(across), F.lit(0)))
    inside = Window.partitionBy("source", "group").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    ordered = ordered.withColumn("own_before", F.coalesce(F.sum("held").over(inside), F.lit(0))).join(groups, ["source", "group"])
    before = ordered.select("source", "block", (F.col("group_before") + F.col("own_before")).alias("block_before"))
    placed = blocked.join(before, ["source", "block"], "left")
    within = Window.partitionBy("source", "block").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("block_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    placed = placed.withColumn("place", place)
    placed = placed.unionByName(weighed.filter("n_tokens = 0"), allowMissingColumns=True)
    whole = F.floor(F.col("budget") / F.col("n"))
    rest = F.col("budget") - whole * F.col("n")
    copies = whole + F.when(F.col("place") < rest, 1).otherwise(0)
    return placed.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("long")).withColumn("position", F.col("place") / F.col("n")).drop("block", "draw", "n", "budget", "block_before", "place")


def mix_sources(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", source: str = "source", budget: int | None = None,
    entropy: float | None = None, repetitions: float | None = None, tokens: str | None = None, seed: int = 0, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row for each document: id, source, ``n_tokens``, ``weight``, ``copies``, ``position``.

    ``copies`` says how often the mix holds the document, 0 if not at all; the budget is
    in tokens, by default as many as there are.  Tokens are taken from the column
    ``tokens``, or are the words of the text, cut at white space.  Exactly one of
    ``entropy`` and ``repetitions`` is the target (see ``find_exponent``).

    A null source is a source like any other.  Documents without tokens have no position,
    no weight if their source has no tokens at all, and no copies unless their source is
    drawn whole.  Rows with one id, or none, are documents of their own, told apart by
    their text; rows equal in both draw alike.  Other columns are ignored; an empty
    table gives no rows.
    """
    count = F.col(tokens).cast("long") if tokens else F.size(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    held = docs.select(
        F.col(id_column).alias("id"),
        # A null would match no weight, an empty name may be taken: names get a mark.
        F.concat(F.when(F.col(source).isNull(), "").otherwise("="), F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("source"),
        F.when(F.col(text).isNull(), 0).otherwise(F.coalesce(count, F.lit(0))).cast("long").alias("n_tokens"),
        F.xxhash64(F.col(id_column).cast("string"), F.col(text)).alias("key"),
    )
    held = stored(held, "tokens")
    totals = stored(source_tokens(held), "sources")
    budget = budget if budget is not None else totals.agg(F.sum("n")).first()[0] or 0
    exponent = find_exponent(totals, budget, entropy, repetitions)
    drawn = schedule(held, mixture(totals, exponent, budget), seed, block_tokens)
    name = F.when(F.col("source") != "", F.expr("substring(source, 2)"))
    return drawn.select(F.col("id").alias(id_column), name.alias(source), "n_tokens", "weight", "copies", "position")
