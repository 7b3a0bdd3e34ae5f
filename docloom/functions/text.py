"""Small text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(content: Column) -> Column:
    """Pieces between line feeds: a trailing feed counts, an empty text has one line."""
    return F.size(F.split(content, "\n", -1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def directory(path: Column) -> Column:
    """Parent directory, '.' for a bare name and '/' for an entry of the root."""
    return (
        F.when(~path.contains("/"), F.lit("."))
        .when(path.rlike("^/[^/]*$"), F.lit("/"))
        .otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))
    )


def word_count(text: Column) -> Column:
    """Whitespace-separated words; 0 for a blank text."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S++"), F.lit(0)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S++"), F.lit(0))


def module_name(go_mod: Column) -> Column:
    """First ``module name`` line of a go.mod text, null when there is none."""
    name = F.regexp_extract(go_mod, r"(?md)^module[ \t]+(\S+?)\r?$", 1)
    return F.when(name != "", name)


def decode_blob(encoding: Column, content: Column) -> Column:
    """Text of a base64 blob (line breaks allowed); null for any other encoding."""
    return F.when(
        encoding == "base64",
        F.decode(F.unbase64(F.regexp_replace(content, r"\s++", "")), "utf-8"),
    )


def fenced_code(text: Column) -> Column:
    """Bodies of all fenced blocks tagged ``go``, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```go(.*?)```"), F.lit(1))
