"""Token-stream view of Go: the comment last seen before the name after ``func``.

Adjacency does not matter here: any comment counts, also one inside the previous
body, and both comment and ``func`` are used up by the next name.  For a method
the first name after ``func`` is the receiver variable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.once import let
from docloom.functions.golang import IDENT
from docloom.functions.golayout import COMMENT, OPAQUE, RAW_STRING, RUNE, STRING

# Words that are never names.
KEYWORDS = (
    "break default select case defer go else goto switch fallthrough if range continue for return "
    "var func struct map chan type interface const import package true false iota nil"
).split()
# Words that are names only when a parenthesis follows.
BUILTIN_TYPES = (
    "uint uint8 uint16 uint32 uint64 int int8 int16 int32 int64 float float32 float64 complex64 "
    "complex128 byte rune string bool error uintptr any comparable"
).split()

_NAME = rf"(?!(?:{'|'.join(KEYWORDS)})\b)(?!(?:{'|'.join(BUILTIN_TYPES)})\b(?!\()){IDENT}"
_SKIPPED = rf"(?:[^\p{{L}}_\"'`/]++|{OPAQUE}|[\"'`/]|(?!{_NAME}){IDENT})"
_FUNC = rf"\bfunc\b{_SKIPPED}*+{_NAME}"
_REST = rf"(?:[^\p{{L}}_\"'`/]++|{RAW_STRING}|{STRING}|{RUNE}|(?!func\b){IDENT}|[\"'`]|/(?![/*]))++"
_TOKENS = rf"(?d){COMMENT}|{_FUNC}|{_REST}|[\s\S]"


def _is_comment(token: Column) -> Column:
    return token.startswith("//") | token.startswith("/*")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s++|\s++\z", "")


def last_comment_pairs(content: Column) -> Column:
    """``array<struct<name, comment>>`` in file order; comment is null when none was seen."""
    tokens = F.filter(
        F.regexp_extract_all(content, F.lit(_TOKENS), F.lit(0)),
        lambda t: _is_comment(t) | t.rlike(r"\Afunc\b"),
    )
    # Between two functions only comments are left, so the entry before a function is
    # the last comment seen, or the function that used up the one before.
    paired = let(
        tokens,
        lambda seen: F.transform(
            seen,
            lambda t, i: F.struct(
                t.alias("token"),
                F.when(i > 0, F.get(seen, i - 1)).alias("before"),
                F.when(
                    ~_is_comment(t),
                    F.filter(F.regexp_extract_all(t, F.lit(rf"(?d){OPAQUE}"), F.lit(0)), _is_comment),
                ).alias("inside"),
            ),
        ),
    )
    functions = F.filter(paired, lambda p: ~_is_comment(p["token"]))
    return F.transform(
        functions,
        lambda p: F.struct(
            F.regexp_extract(p["token"], r"([\p{L}_][\p{L}\p{Nd}_]*)\z", 1).alias("name"),
            F.when(F.size(p["inside"]) > 0, _strip(F.get(p["inside"], F.size(p["inside"]) - 1)))
            .when(_is_comment(p["before"]), _strip(p["before"]))
            .alias("comment"),
        ),
    )
