"""Named entities of several words, looked up in a gazetteer table of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.once import let
from docloom.session import stored

#: A word: letters, digits and whatever is not ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"

#: Slots of the flags that say which words may begin a name.
SLOTS = 1 << 16


def words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))


def name_tables(gazetteer: DataFrame, name: str = "name", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """``(phrase, label, name_id)``, one row a name, and ``(first, lengths)``: how long the names are that begin with a word.

    Of several labels of a name the first by alphabet counts.  Names without words and
    names without a label drop out.
    """
    cut = gazetteer.select(words(name).alias("w"), F.col(label).alias("label")).filter((F.size("w") > 0) & F.col("label").isNotNull())
    names = cut.groupBy(F.array_join("w", " ").alias("phrase")).agg(F.min("label").alias("label"))
    names = stored(names.withColumn("name_id", F.monotonically_increasing_id()))
    each = names.select(F.substring_index("phrase", " ", 1).alias("first"), F.size(F.split("phrase", " ")).alias("n"))
    return names, stored(each.groupBy("first").agg(F.collect_set("n").alias("lengths")))


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS))


def _may_begin(firsts: DataFrame) -> Callable[[Column], Column]:
    """Whether a word may be one of the first words: a byte for each slot of a hash.

    The flags are of one size whatever the gazetteer's; the join with the table decides.
    """
    flags = bytearray(SLOTS)
    for (slot,) in firsts.select(_slot(F.col("first"))).distinct().collect():
        flags[slot] = 1
    table = F.lit(bytes(flags))
    return lambda word: F.substring(table, (_slot(word) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")


def _chosen(matches: Column, most: int) -> Column:
    """Of matches ``(begin, -n, name_id)`` in order, the longest at its place, from the left, without overlaps.

    A match overlaps none but the ``most`` places before it, so the array falls into chains
    of matches that overlap, and only inside a chain are matches chosen one after another.
    """

    def end(m: Column) -> Column:
        return m["begin"] - m["minus_n"]

    def chains(m: Column) -> Column:
        def apart(x: Column, at: Column) -> Column:
            first = F.greatest(at - F.lit(most) + 1, F.lit(1))
            return ~F.exists(F.slice(m, first, at - first + 1), lambda y: end(y) > x["begin"])

        flags = F.transform(m, lambda x, at: F.when(apart(x, at), at + 1))
        starts = F.concat(F.array_compact(flags), F.array(F.size(m) + 1))
        return let(starts, lambda s: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda b, k: F.slice(m, b, F.get(s, k + 1) - b)))

    def from_left(chain: Column) -> Column:
        return F.aggregate(
            F.slice(chain, F.lit(2), F.size(chain) - 1),
            F.slice(chain, F.lit(1), F.lit(1)),
            lambda kept, x: F.when(x["begin"] >= end(F.element_at(kept, -1)), F.concat(kept, F.array(x))).otherwise(kept),
        )

    longest = let(matches, lambda m: F.filter(m, lambda x, at: (at == 0) | (F.get(m, at - 1)["begin"] != x["begin"])))
    return let(longest, lambda m: F.flatten(F.transform(chains(m), from_left)))


def entity_spans(df: DataFrame, gazetteer: DataFrame, id_columns: list[str], text: str = "text", name: str = "name", label: str = "label") -> DataFrame:
    """``(ids, begin, end, name, label)``: names in each text, from the left, the longest first.

    ``begin`` and ``end`` (exclusive) number the words of the text from 0; names are
    matched by their words, in the letter case given.  A name that overlaps one chosen
    before it is left out.

    Flags tell in the row which words may begin a name; only those meet the table of first
    words, with as many words as the longest name has.  Both tables are written before they are joined, so
    their true sizes decide whether they are broadcast.  Matches travel as three numbers
    and are put in order by text: there are no more of them than the text has words, times
    the lengths that names have.  Null and empty texts have no names; rows equal in ids and
    text are one; null ids are ids.
    """
    names, firsts = name_tables(gazetteer, name, label)
    key = ["_key", *[f"_id{k}" for k in range(len(id_columns))]]
    ids = [F.col(f"`{c}`").alias(k) for c, k in zip(id_columns, key[1:], strict=True)]
    most = firsts.agg(F.max(F.array_max("lengths"))).first()[0] or 1
    may_begin = _may_begin(firsts)

    # A place takes along as many words as the longest name has, never the whole text.
    def places_of(w: Column) -> Column:
        numbered = F.transform(w, lambda x, at: F.when(may_begin(x), F.struct(at.alias("begin"), x.alias("first"))))
        return F.transform(F.array_compact(numbered), lambda p: F.struct(p["begin"].alias("begin"), p["first"].alias("first"), F.slice(w, p["begin"] + 1, F.lit(most)).alias("w")))

    places = let(words(text), places_of)
    rows = df.select(F.xxhash64(text, F.length(text)).alias("_key"), *ids, F.explode(places).alias("p"))
    begun = rows.select(*key, "p.begin", "p.first", "p.w").join(firsts, "first")
    fitting = F.filter("lengths", lambda n: n <= F.size("w"))
    tried = begun.select(*key, "begin", F.explode(F.transform(fitting, lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", F.lit(1), n), " ").alias("phrase")))).alias("t"))
    met = tried.select(*key, "begin", (-F.col("t.n")).alias("minus_n"), F.col("t.phrase").alias("phrase")).join(names.select("phrase", "name_id"), "phrase")
    # Of rows equal in ids and text each gives the same matches: one set of them.
    matches = met.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("begin", "minus_n", "name_id"))).alias("m"))
    spans = matches.select(*key, F.explode(_chosen(F.col("m"), most)).alias("s"))
    spans = spans.select(*key, "s.begin", (F.col("s.begin") - F.col("s.minus_n")).alias("end"), F.col("s.name_id").alias("name_id")).join(names, "name_id")
    return spans.select(*[F.col(k).alias(c) for k, c in zip(key[1:], id_columns, strict=True)], "begin", "end", F.col("phrase").alias("name"), "label")
