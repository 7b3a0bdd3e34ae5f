"""Go source in any layout, brought into the one that ``golang`` reads.

A file is cut into tokens; the running sum of opening and closing brackets gives each token
its depth, however deep.  Where depth is 0 a declaration may begin, inside a group of
constants, variables or types its members do; both get a line of their own there, with the
indentation that tells them apart.  Function bodies keep theirs.

Running sums go by doubling: a file of n tokens takes log n passes over its own array, and
only files in another layout are cut into tokens at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.once import let

LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
STRING = r'"(?:[^"\\\n]++|\\.)*+"'
RAW_STRING = r"`[^`]*+`"
RUNE = r"'(?:[^'\\\n]++|\\.)++'"
COMMENT = rf"{LINE_COMMENT}|{BLOCK_COMMENT}"
OPAQUE = rf"{RAW_STRING}|{STRING}|{RUNE}|{COMMENT}"
# The rest of a line; a string or comment that spans lines stays in one piece.
CODE_LINE = rf"(?:[^\n\"'`/]++|{OPAQUE}|[\"'`/])*+(?:\n|\z)"

# A file in the usual layout, by its lines: declarations in column 0; a line that ends with
# an opening bracket or an operator there goes on in lines indented by tabs, and closing
# brackets end them in column 0.  Members of a group have one tab.
_OPEN = r"(?<=[(\[{,=+*/&|<>.-]\n)"
_BODY = rf"(?:^\t++(?! ){CODE_LINE}|^\n)*+"
_GROUP = rf"^(?:const|var|type) \(\n(?:^\t(?![ \t])(?:[^\n;\"'`/]++|{OPAQUE}|/)*+\n|^\n)*+^\)(?:\n|\z)"
_ITEM = rf"^(?:package|import|const|var|type|func)\b(?![ \t]*+\()(?:(?:[^\n;\"'`/]++|{OPAQUE}|/)*+(?:\n|\z))"
_FUNC = rf"^func\b(?:(?:[^\n;\"'`/]++|{OPAQUE}|/)*+(?:\n|\z))"
_IMPORT = rf"^import \(\n{_BODY}^\)(?:\n|\z)"
USUAL = (
    rf"(?md)\A(?:^\n|^(?:{COMMENT})[ \t]*+(?:\n|\z)|{_GROUP}|{_IMPORT}"
    rf"|(?:{_ITEM}|{_FUNC})(?:{_OPEN}{_BODY}(?:^[)}}\]](?:[^\n;\"'`/]++|{OPAQUE}|/)*+(?:\n|\z))?+(?:{_OPEN}{_BODY}^[)}}\]]{CODE_LINE})*+)?+)*+\z"
)

TOKEN = rf"(?d){OPAQUE}|\n|[ \t\r]++|[;()\[\]{{}}]|[^\s;()\[\]{{}}\"'`/]++|[\s\S]"
#: Passes of a running sum: enough for any text that fits into a row.
PASSES = 31
#: A line end after these ends a statement.
ENDS_STATEMENT = r"(?:[\p{L}\p{Nd}_)\]}\"'`]|\+\+|--)\z"
#: Tokens looked back over for the last one that is neither blank nor comment.
BACK = 6


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running combination of an array of whole numbers not changed by a 0."""

    def doubled(v: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        shifted = F.concat(F.array_repeat(F.lit(0), step), F.slice(v, F.lit(1), F.size(v) - step))
        return F.when(F.size(v) > step, F.zip_with(v, shifted, combine)).otherwise(v)

    return F.aggregate(F.array(*[F.lit(k) for k in range(PASSES)]), values, doubled)


def _step(token: Column) -> Column:
    opened = F.when(token.rlike(r"\A[(\[{]"), 1)
    return opened.when(token.rlike(r"\A[)\]}]"), -1).otherwise(0)


def depth_tokens(text: Column) -> Column:
    """``array<struct<t, after, d>>``: token, depth after it, and its own (a bracket stands
    on the depth outside of it).  The tokens joined are the text."""

    def deep(tokens: Column) -> Column:
        depth = running(F.transform(tokens, _step), lambda a, b: a + b)
        return F.zip_with(
            tokens, depth,
            lambda t, a: F.struct(t.alias("t"), a.alias("after"), F.when(t.rlike(r"\A[(\[{]"), a - 1).otherwise(a).alias("d")),
        )

    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), deep)


def shallow(text: Column, most: int) -> Column:
    """The text without what lies deeper than ``most`` brackets."""
    kept = F.filter(depth_tokens(text), lambda x: x["d"] < most)
    return F.array_join(F.transform(kept, lambda x: x["t"]), "")


_BLANK, _ASIDE = r"\A[ \t\r]", r"\A(?:[ \t\r]|//|/\*)"


def _with_neighbours(items: Column) -> Column:
    """Adds ``last``, the last token before that is neither blank nor comment, and ``next``,
    the first after that is not blank; '' where there is none."""

    def seen(x: Column, i: Column) -> Column:
        some = F.slice(items, F.greatest(i - BACK, F.lit(0)) + 1, F.least(i, F.lit(BACK)))
        last = F.try_element_at(F.filter(some, lambda y: ~y["t"].rlike(_ASIDE)), F.lit(-1))["t"]
        one = F.get(items, i + 1)["t"]
        following = F.when(one.rlike(_BLANK), F.get(items, i + 2)["t"]).otherwise(one)
        none = F.lit("")
        return F.struct(x["t"].alias("t"), x["after"].alias("after"), x["d"].alias("d"), F.coalesce(last, none).alias("last"), F.coalesce(following, none).alias("next"))

    return F.transform(items, seen)


def _with_places(items: Column) -> Column:
    """Adds ``in``, what the last bracket of depth 0 opened (1 a group of members, 2 a type's
    body, else 0), and ``cut``, whether a line must end after the token: after a semicolon
    between two statements, a group's bracket, or a comment block before a declaration."""

    def opened(x: Column, i: Column) -> Column:
        kind = F.when((x["t"] == "(") & x["last"].rlike(r"\A(?:const|var|type)\z"), 1).when((x["t"] == "{") & x["last"].rlike(r"\A(?:struct|interface)\z"), 2).otherwise(0)
        return F.when((x["d"] == 0) & x["t"].rlike(r"\A[(\[{]"), (i + 1) * 4 + kind).otherwise(0)

    def placed(x: Column, mark: Column) -> Column:
        inside = mark % 4
        goes_on = ~x["next"].rlike(r"\A(?:[\n)}]|//|/\*|\z)")
        statement = (x["t"] == ";") & goes_on & ((x["d"] == 0) | ((x["d"] == 1) & (inside == 1)))
        group = (x["t"] == "(") & goes_on & (x["d"] == 0) & (inside == 1)
        head = x["t"].startswith("/*") & (x["d"] == 0) & x["last"].rlike(r"\A[\n;]?\z") & x["next"].rlike(r"\A(?:const|var|type|func)\z")
        return F.struct(x["t"].alias("t"), x["after"].alias("after"), x["d"].alias("d"), x["last"].alias("last"), x["next"].alias("next"), inside.alias("in"), (statement | group | head).alias("cut"))

    return F.zip_with(items, running(F.transform(items, opened), lambda a, b: F.greatest(a, b)), placed)


def relaid(text: Column) -> Column:
    """The text with every declaration and every member of a group on a line of its own."""
    none, tab, line = F.lit(""), F.lit("\t"), F.lit("\n")

    def indent(x: Column, following: Column) -> Column:
        goes_on = ~x["last"].rlike(rf"\A(?:[\n;(\[{{]|\z)|{ENDS_STATEMENT}")
        closing = x["next"].rlike(r"\A[)\]}]")
        level = x["after"] - F.when(closing, 1).when(goes_on & (x["in"] == 1) & (x["after"] == 1), -1).otherwise(0)
        return (
            F.when(x["next"].rlike(r"\A\n?\z"), none)
            .when(x["after"] == 0, F.when(goes_on, tab).otherwise(none))
            .when((x["in"] > 0) | (closing & (x["after"] == 1)), F.repeat(tab, level))
            # A function's body or a list keeps the indentation that it has.
            .when(closing | following.rlike(_BLANK), none)
            .otherwise(tab)
        )

    def laid(x: Column, i: Column, items: Column) -> Column:
        t, before = x["t"], F.get(items, i - 1)
        newline = (before["t"] == "\n") & ((before["after"] == 0) | (before["in"] > 0) | ((before["after"] == 1) & x["next"].rlike(r"\A[)\]}]")))
        member = F.when((x["d"] == 1) | (t == "("), F.lit("\n\t")).otherwise(line)
        grouped = (x["d"] == 0) & (x["in"] == 1)
        spaced = F.when(before["t"].rlike(_BLANK), t).otherwise(F.lit(" ("))
        return (
            F.when(t == "\n", F.concat(t, indent(x, F.coalesce(F.get(items, i + 1)["t"], none))))
            .when(t == ";", F.when(x["cut"], member).when((x["d"] == 0) | ((x["d"] == 1) & (x["in"] == 1)), none).otherwise(t))
            .when(t.rlike(_BLANK), F.when(F.coalesce(newline | before["cut"], F.lit(True)), none).otherwise(t))
            .when((t == "(") & grouped, F.concat(spaced, F.when(x["cut"], member).otherwise(none)))
            .when((t == ")") & grouped & ~x["last"].rlike(r"\A[\n(]"), F.lit("\n)"))
            # On the declaration's own line it documents nothing, so it is set apart.
            .when(x["cut"], F.concat(t, F.lit("\n\n")))
            .otherwise(t)
        )

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x, i: laid(x, i, items)), "")

    return let(let(let(depth_tokens(text), _with_neighbours), _with_places), joined)


def needs_layout(text: Column) -> Column:
    """Whether lines stand where ``golang`` does not look for them.

    Lines are judged by the depth they begin on.  A file that could be read as it is may be
    laid out again, which changes nothing that is read.
    """
    lines = F.regexp_extract_all(text, F.lit(rf"(?d)(?!\z){CODE_LINE}"), F.lit(0))
    bare = F.transform(lines, lambda line: F.regexp_replace(line, rf"(?d){OPAQUE}", "_"))

    def judged(lines: Column) -> Column:
        def change(line: Column) -> Column:
            opened = F.length(F.regexp_replace(line, r"[^(\[{]++", ""))
            return opened - F.length(F.regexp_replace(line, r"[^)\]}]++", ""))

        def odd(line: Column, depth: Column, last: Column) -> Column:
            outside = line.rlike(
                r"\A(?:[ \t]++|_[ \t]*+)(?:const|var|type|func)\b|;[ \t]*+[^ \t\n]|\A(?:const|var|type)(?:\(|[ \t]++\([ \t]*+[^ \t\n])"
            )
            inside = line.rlike(r"\A(?:[^ \t\n)}\]:]++(?:\n|\z|[^:\n])|\t*+ )")
            member = (line.rlike(r"\A\t[ \t]++[^ \t\n)}\]]") & last.rlike(r"[\p{L}\p{Nd}_)\]}][ \t]*+\n")) | line.rlike(
                r"\A\t(?!(?:for|if|switch|else|case|select|go|defer|func)\b|\})[^\n;]*+;[ \t]*+[^ \t\n]"
            )
            return F.when(depth <= 0, outside).otherwise(inside | ((depth == 1) & member))

        def with_depth(depth: Column) -> Column:
            return F.exists(
                F.transform(lines, lambda line, i: F.coalesce(odd(line, F.get(depth, i) - change(line), F.coalesce(F.get(lines, i - 1), F.lit(""))), F.lit(False))),
                lambda found: found,
            )

        return let(running(F.transform(lines, change), lambda a, b: a + b), with_depth)

    return let(bare, judged)


def readable(text: Column) -> Column:
    """The text, in the layout that is read.  Most files pass one regular expression."""
    return let(text, lambda t: F.when(~t.rlike(USUAL) & needs_layout(t), relaid(t)).otherwise(t))
