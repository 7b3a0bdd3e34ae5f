"""Identifiers to words and phrases."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.once import let
from docloom.functions.text import word_count


def snake_words(name: Column) -> Column:
    """``GetHTTPCode`` -> ``get http code``; only ASCII letters mark a word start."""
    text = F.regexp_replace(name, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    text = F.regexp_replace(text, r"[-_\s]++", " ")
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def is_exported(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def is_constructor(name: Column) -> Column:
    return name.startswith("New")


def indefinite_article(word: Column) -> Column:
    return F.when(F.lower(F.substring(word, 1, 1)).isin("a", "e", "i", "o", "u"), F.lit("an")).otherwise(F.lit("a"))


def value_phrase(name: Column) -> Column:
    """Phrase for a variable or constant; '' for a single word."""

    def phrase(text: Column) -> Column:
        return (
            F.when(word_count(text) < 2, F.lit(""))
            .when(
                text.contains("url"),
                F.concat(
                    F.lit(" that indicates the endpoint URL for accessing to "),
                    F.replace(text, F.lit("url"), F.lit("")),
                ),
            )
            .otherwise(text)
        )

    return let(snake_words(name), phrase)


# Leading letters of a function name and the phrase put for them.
# The first match wins, and the letters need not be a whole word.
VERB_PHRASES = {
    "get": " that retrieve the",
    "set": " which update the",
    "init": " to initializes the",
    "is": " to check the",
    "has": " to check the",
}
OTHER_VERB_PHRASE = " which execute "


def function_phrase(name: Column) -> Column:
    """Phrase for a function; '' for a single word."""

    def phrase(text: Column) -> Column:
        found = F.when(word_count(text) < 2, F.lit(""))
        for prefix, lead in VERB_PHRASES.items():
            rest = F.substr(text, F.lit(len(prefix) + 1))
            found = found.when(text.startswith(prefix), F.concat(F.lit(lead), rest))
        return found.otherwise(F.concat(F.lit(OTHER_VERB_PHRASE), text))

    return let(snake_words(name), phrase)
