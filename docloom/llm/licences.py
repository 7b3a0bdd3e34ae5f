"""Licence scans: texts in a canonical form, looked up by digest among known licences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.once import let
from docloom.llm.licence_texts import KNOWN

#: Spellings that count as equal, as parts of words in lower case; a blank
#: stands for the beginning of a word.  Applied in this order.
SPELLINGS = [
    ("licenc", "licens"),
    (" sub licens", " sublicens"),
    (" non commercial", " noncommercial"),
    (" non infring", " noninfring"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("realis", "realiz"),
    ("utilis", "utiliz"),
    ("initialis", "initializ"),
    ("maximis", "maximiz"),
    ("optimis", "optimiz"),
    ("emphasis", "emphasiz"),
    ("categoris", "categoriz"),
    ("capitalis", "capitaliz"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("behaviour", "behavior"),
    ("honour", "honor"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    (" centre", " center"),
    (" wilful", " willful"),
    (" per cent", " percent"),
    (" whilst", " while"),
    ("https", "http"),
    ("copyright owner", "copyright holder"),
    ("copyright holders", "copyright holder"),
]
#: Everything of ASCII but letters, digits and line feeds, and typographic marks.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F‘’“”«»–—•]+"
#: What follows "copyright" in the terms themselves, where lines are broken before it.
TERMS = "and|as|disclaimer|for|holder|if|in|interests?|is|it|laws?|licens(e|es|ed|ing|or|able)|notices?|of|on|or|owners?|permission|protection|statement|that|the (library|program|software|work)|this|to|treat(y|ies)|which"
#: Lines that name who holds the rights, after punctuation has gone, unless they begin a term.
COPYRIGHT = r"^((portions )?(copyright|copr) .|© |c (19|20)[0-9][0-9]|all rights reserved$)"
TERM_LINE = rf"^(portions )?(copyright|copr) ({TERMS})( |$)"
BLOCK_END = r"\n *(\n *)+"


def canonical_lines(text: Column) -> Column:
    """Lower case without punctuation and in one spelling; line feeds stay."""
    plain = F.lower(F.regexp_replace(text, PUNCTUATION, " "))
    spaced = F.concat(F.lit(" "), F.replace(plain, F.lit("\n"), F.lit("\n ")))
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), SPELLINGS, spaced)


def _joined(block: Column) -> Column:
    """One unit: a block's lines, without copyright lines, in one."""
    lines = F.transform(F.split(block, "\n", -1), lambda line: F.trim(line))
    return F.array_join(F.filter(lines, lambda line: (line != "") & (~line.rlike(COPYRIGHT) | line.rlike(TERM_LINE))), " ")


def units(text: Column) -> Column:
    """What is looked up: the whole text first, then its blocks and its lines, each once."""

    def parts(canonical: Column) -> Column:
        blocks = F.transform(F.split(canonical, BLOCK_END, -1), _joined)
        lines = F.transform(F.split(canonical, "\n", -1), _joined)
        return F.array_distinct(F.concat(F.array(_joined(canonical)), blocks, lines))

    return let(canonical_lines(F.coalesce(text, F.lit(""))), parts)


def known_licences(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(licence, text) of the built-in texts; any table of these columns will do."""
    return spark.createDataFrame(texts if texts is not None else KNOWN, "licence string, text string")


def digests(known: DataFrame) -> DataFrame:
    """(digest, licence): one licence for each canonical text, the first by name."""
    unit = _joined(canonical_lines(F.coalesce(F.col("text"), F.lit(""))))
    rows = known.select("licence", unit.alias("unit")).filter("unit <> ''")
    return rows.groupBy(F.sha2("unit", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row for each document: id, ``whole_licence`` and ``licences`` (sorted).

    A unit is the whole text, a block between empty lines, or a line.  A unit is a licence
    if its canonical digest is that of a known text; parts of a unit do not count.

    Units meet the known digests in an equi-join whose strategy Spark picks by their
    size; only matches are gathered, by a hash of the row.  Null and empty texts have no
    licence.  Rows equal in id and text have the same result; null ids and repeated rows
    stay as they are; other columns are ignored; no known texts, no licences; an empty
    table gives no rows.
    """
    key = F.xxhash64(F.col(id_column).cast("string"), F.col(text), F.col(id_column).isNull())
    exploded = docs.select(key.alias("key"), F.posexplode(units(F.col(text))).alias("at", "unit")).filter("unit <> ''")
    found = exploded.select("key", "at", F.sha2("unit", 256).alias("digest")).join(digests(known), "digest")
    found = found.groupBy("key").agg(
        F.min(F.when(F.col("at") == 0, F.col("licence"))).alias("whole_licence"), F.array_sort(F.collect_set("licence")).alias("licences")
    )
    rows = docs.select(F.col(id_column), key.alias("key")).join(found, "key", "left")
    return rows.select(id_column, "whole_licence", F.coalesce("licences", F.array().cast("array<string>")).alias("licences"))
