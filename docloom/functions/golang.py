"""Go source text as Spark columns.

A file is cut into *lexemes* by one possessive regular expression that covers
the text without gaps, so joining the lexemes gives the file back (laid out again, if
``golayout`` had to do that first).  Every
top-level declaration, together with the comment block that touches it, is one
lexeme; strings and comments are consumed whole, so a ``func`` inside them is
never seen.  All later steps are array transforms on that one row: no shuffle,
no Python worker.

Only possessive quantifiers are used.  Greedy or lazy groups recurse in
``java.util.regex`` and a long comment would overflow the task's stack.

The expressions expect top-level keywords in column 0 and indented lines below them;
``golayout`` brings other files into that form.  ``unread`` finds what is lost all the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.golayout import (
    BLOCK_COMMENT,
    CODE_LINE,
    COMMENT,
    LINE_COMMENT,
    OPAQUE,
    readable,
    shallow,
)
from docloom.functions.once import built_once, let

IDENT = r"[\p{L}_][\p{L}\p{Nd}_]*+"
NAMES = rf"{IDENT}(?:, *+{IDENT})*+"

def _nested(opening: str, closing: str, depth: int) -> str:
    """A bracket pair with up to ``depth`` further pairs of its kind inside."""
    plain = rf"[^{opening}{closing}\"'`/]++|{OPAQUE}|/"
    pattern = rf"{opening}(?:{plain})*+{closing}"
    for _ in range(depth):
        pattern = rf"{opening}(?:{plain}|{pattern})*+{closing}"
    return pattern


# Headers and types nested deeper than this lose what lies deeper, which no rendered type shows.
DEEPEST = 8
PAREN = _nested(r"\(", r"\)", 16)
BRACKET = _nested(r"\[", r"\]", 8)
BRACE = _nested(r"\{", r"\}", 8)

# A bare result type: stops before the body's brace, a comment or a line end.
TYPE_TEXT = (
    rf"(?:\b(?:interface|struct)\b[ \t]*+{BRACE}|[\p{{L}}\p{{Nd}}_]++|{PAREN}|{BRACKET}"
    r"|[*.<\-]|[ \t]++(?=[^{/\s]))++"
)
HEADER = (
    rf"func[ \t]++(?:({PAREN})[ \t]*+)?+({IDENT})({BRACKET})?+[ \t]*+({PAREN})"
    rf"(?:[ \t]*+({PAREN}|{TYPE_TEXT}))?+"
)
HEADER_RECEIVER, HEADER_NAME, HEADER_PARAMS, HEADER_RESULTS = 1, 2, 4, 5

_DOC_LINE = rf"^(?:{LINE_COMMENT}|{BLOCK_COMMENT}[ \t]*+)(?:\n|\z)"
_MORE_LINES = rf"(?:^[ \t]{CODE_LINE}|^\n)*+(?:^[)}}]{CODE_LINE})?+"
_DECLARATION = (
    rf"(?:^func[ \t]++(?=[\p{{L}}_(]){CODE_LINE}(?:^[ \t)}}]{CODE_LINE}|^\n)*+"
    rf"|^(?:const|var|type)[ \t]++\({CODE_LINE}{_MORE_LINES}"
    rf"|^(?:const|var|type)[ \t]++(?={IDENT}){CODE_LINE}{_MORE_LINES})"
)
LEXEME = (
    rf"(?md)(?!\z)(?:(?:{_DOC_LINE})++{_DECLARATION}?+|{_DECLARATION}"
    rf"|{CODE_LINE}(?:^[ \t)}}]{CODE_LINE}|^\n)*+)"
)
# One entry of a grouped declaration, one tab deep.
_SPEC_DOC_LINE = rf"^\t(?:{LINE_COMMENT}|{BLOCK_COMMENT}[ \t]*+)\n"
_SPEC = rf"(?:^\t(?={IDENT}){CODE_LINE}(?:^\t[ \t)}}]{CODE_LINE}|^\n)*+)"
SPEC_LEXEME = rf"(?md)(?!\z)(?:(?:{_SPEC_DOC_LINE})++{_SPEC}?+|{_SPEC}|{CODE_LINE})"

_LEADING_DOC = rf"(?md)\A((?:{_DOC_LINE})*+)"
_LEADING_SPEC_DOC = rf"(?md)\A((?:{_SPEC_DOC_LINE})*+)"
_LIST_PIECE = rf"(?:[^,()\[\]{{}}]++|{PAREN}|{BRACKET}|{BRACE})++"
# ``name Type``; the excluded words start a type of their own.
_NAMED_PIECE = rf"\A(?!(?:chan|func|map|interface|struct)\b)({IDENT})[ \t\n]++(\S[\s\S]*+)\z"


def unix_lines(content: Column) -> Column:
    return F.replace(content, F.lit("\r\n"), F.lit("\n"))


@built_once
def lexemes(content: Column) -> Column:
    """Gap-free cut of a file: ``array_join(lexemes, '')`` is the file, in a readable layout."""
    return F.regexp_extract_all(readable(unix_lines(content)), F.lit(LEXEME), F.lit(0))


def code_only(content: Column) -> Column:
    """The text without strings and comments."""
    return F.regexp_replace(content, rf"(?d){OPAQUE}", "")


@built_once
def parses(content: Column) -> Column:
    """Whether a file looks like Go: a package clause and balanced brackets."""

    def test(code: Column) -> Column:
        balanced = code.rlike(rf"(?md)^[ \t]*+package[ \t]++{IDENT}[ \t]*+(?:;|$)")
        for opening, closing in ("()", "[]", "{}"):
            unopened = F.length(F.translate(code, opening, ""))
            unclosed = F.length(F.translate(code, closing, ""))
            balanced = balanced & (unopened == unclosed)
        return balanced

    # The cheap test first: most texts that are no Go stop there.
    return content.rlike(r"(?m)^[ \t]*+package[ \t]") & let(code_only(unix_lines(content)), test)


@built_once
def unread(content: Column) -> Column:
    """Whether the text declares more than is read: a function by name, a constant, variable
    or type at the beginning of a line, or a member of a group.

    A name after ``func`` or after ``func (...)`` declares one; literals and types have none.
    """

    def lost(parts: Column) -> Column:
        code = code_only(F.array_join(F.transform(parts, lambda x: x["text"]), ""))
        named = F.regexp_extract_all(shallow(code, DEEPEST), F.lit(rf"(?d)\bfunc[ \t]++(?:{PAREN}[ \t]*+)?+{IDENT}[ \t]*+[\[(]"), F.lit(0))
        begun = F.regexp_extract_all(code, F.lit(r"(?md)^(?:const|var|type)\b"), F.lit(0))
        functions = function_parts(F.filter(parts, lambda x: x["kind"] == "func"))
        values = spec_parts(F.filter(parts, lambda x: x["kind"].isin("const", "var", "type")))
        gap = r"(?d)\A(?:[\s;]*+|(?:const|var|type)[ \t]++\([\s)]*+|\)\s*+)\z"
        strange = F.exists(values, lambda v: F.exists(v["specs"], lambda s: (F.size(s["names"]) == 0) & ~code_only(s["text"]).rlike(gap)))
        return (F.size(named) > F.size(F.filter(functions, lambda d: d["name"] != ""))) | (F.size(begun) > F.size(values)) | strange

    return let(lexeme_parts(lexemes(content)), lost)


def doc_text(comment: Column) -> Column:
    """Text of a comment block: markers and directives removed, blank runs folded,
    exactly one line feed at the end ('' when nothing is left)."""

    def body(one: Column) -> Column:
        """Each comment by its own kind: a line's marker and one blank, or a block's two ends."""
        return F.when(one.startswith("//"), F.regexp_replace(one, r"\A// ?+", "")).otherwise(
            F.substr(one, F.lit(3), F.length(one) - 4)
        )

    each = F.regexp_extract_all(comment, F.lit(f"(?d){COMMENT}"), F.lit(0))
    each = F.filter(each, lambda one: ~one.rlike(r"\A//(?:line |extern |export |[a-z0-9]++:[a-z0-9])"))
    text = F.array_join(F.transform(each, body), "\n")
    text = F.regexp_replace(text, r"(?md)[ \t\r]++$", "")
    text = F.regexp_replace(text, r"\n{3,}+", "\n\n")
    text = F.regexp_replace(text, r"\A\n++|\n++\z", "")
    return let(text, lambda t: F.when(t == "", t).otherwise(F.concat(t, F.lit("\n"))))


def type_name(text: Column) -> Column:
    """Canonical text of a type: array lengths, interface methods and function
    signatures are dropped; what has no canonical form is ``unknown``."""
    text = F.trim(F.regexp_replace(text, r"\s++", " "))
    text = F.regexp_replace(text, rf"\binterface ?+{BRACE}", "interface{}")
    text = F.regexp_replace(text, rf"\bstruct\b(?: ?+{BRACE})?+", "unknown")
    text = F.regexp_replace(text, r"\bfunc ?+\(.*+", "func")
    text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{Nd}}_.])(?!map\[)(?:{IDENT}\.)?+{IDENT}{BRACKET}", "unknown")
    text = F.regexp_replace(text, r"(?<!map)\[[^\[\]]*+\]", "[]")
    text = F.regexp_replace(text, PAREN, "unknown")
    return let(
        text, lambda t: F.when((t == "") | t.startswith("..."), F.lit("unknown")).otherwise(t)
    )


def _pieces(parenthesised: Column) -> Column:
    inner = F.regexp_replace(parenthesised, rf"(?d){COMMENT}", "")
    inner = F.regexp_replace(inner, r"\A\(|\)\z", "")
    pieces = F.transform(
        F.regexp_extract_all(inner, F.lit(_LIST_PIECE), F.lit(0)),
        lambda piece: F.regexp_replace(piece, r"\A\s++|\s++\z", ""),
    )
    return F.filter(pieces, lambda piece: piece != "")


def field_list(parenthesised: Column) -> Column:
    """Parameters or results as ``array<struct<name, type>>``.

    ``a, b int`` gives one entry per name; unnamed entries have name ''.
    """
    pieces = F.transform(
        _pieces(parenthesised),
        lambda piece: F.struct(
            piece.alias("piece"),
            F.regexp_extract(piece, _NAMED_PIECE, 2).alias("own"),
        ),
    )

    def entry(item: Column, index: Column, items: Column) -> Column:
        later = F.filter(F.slice(items, index + 1, F.size(items)), lambda other: other["own"] != "")
        own = F.when(item["own"] != "", item["own"]).otherwise(F.get(later, F.lit(0))["own"])
        named = F.exists(items, lambda other: other["own"] != "")
        return F.struct(
            F.when(named, F.regexp_extract(item["piece"], rf"\A({IDENT})", 1))
            .otherwise(F.lit(""))
            .alias("name"),
            type_name(F.when(named, F.coalesce(own, F.lit(""))).otherwise(item["piece"])).alias("type"),
        )

    return let(pieces, lambda items: F.transform(items, lambda item, index: entry(item, index, items)))


def receiver_parts(receiver: Column) -> Column:
    """Base type name and pointer mark of ``(r *T[K])``; name '' when there is none."""
    pattern = rf"\A\(\s*+(?:{IDENT}\s++(?!\)))?+(\*?+)\s*+({IDENT})"
    return F.struct(
        F.regexp_extract(receiver, pattern, 2).alias("base"),
        (F.regexp_extract(receiver, pattern, 1) == "*").alias("is_ptr"),
    )


def signature(decl: Column) -> Column:
    """``func (r *T) Name(p T, ...) (R, ...)``; results are always parenthesised."""
    params = F.transform(
        decl["params"],
        lambda p: F.when(p["name"] == "", p["type"]).otherwise(F.concat_ws(" ", p["name"], p["type"])),
    )
    base = decl["receiver"]["base"]
    receiver = F.when(base == "", F.lit("")).otherwise(
        F.concat(
            F.lit("("), F.lower(F.substring(base, 1, 1)), F.lit(" "),
            F.when(decl["receiver"]["is_ptr"], F.lit("*")).otherwise(F.lit("")), base, F.lit(") "),
        )
    )
    return F.concat(
        F.lit("func "), receiver, decl["name"],
        F.lit("("), F.array_join(params, ", "),
        F.lit(") ("), F.array_join(F.transform(decl["results"], lambda r: r["type"]), ", "), F.lit(")"),
    )


def lexeme_parts(texts: Column) -> Column:
    """Each lexeme with its comment block, code and the kind of declaration it holds
    ('' for everything else)."""
    texts = F.transform(
        texts,
        lambda text: F.struct(text.alias("text"), F.regexp_extract(text, _LEADING_DOC, 1).alias("comment")),
    )
    texts = F.transform(
        texts,
        lambda x: x.withField("code", F.substr(x["text"], F.length(x["comment"]) + 1)),
    )
    return F.transform(
        texts,
        lambda x: x.withField("kind", F.regexp_extract(x["code"], r"\A(func|const|var|type)[ \t]", 1)).withField(
            "has_paren", x["code"].rlike(r"\A(?:const|var|type)[ \t]+\(")
        ),
    )


def function_parts(items: Column) -> Column:
    """``array<struct<..., doc, name, receiver, params, results>>`` for function lexemes."""
    # Most headers are read as they are; only nested ones are cut at a depth first.
    def header(code: Column) -> Column:
        plain = F.regexp_extract(code, rf"(?d)\A{HEADER}", 0)
        return let(plain, lambda h: F.when(h != "", h).otherwise(F.regexp_extract(shallow(code, DEEPEST), rf"(?d)\A{HEADER}", 0)))

    items = F.transform(items, lambda x: x.withField("header", header(x["code"])))

    def group(item: Column, number: int) -> Column:
        return F.regexp_extract(item["header"], rf"(?d)\A{HEADER}", number)

    def results(item: Column) -> Column:
        return let(
            F.trim(group(item, HEADER_RESULTS)),
            lambda t: F.when((t == "") | t.startswith("("), t).otherwise(F.concat(F.lit("("), t, F.lit(")"))),
        )

    return F.transform(
        items,
        lambda x: x.withField("doc", doc_text(x["comment"]))
        .withField("name", group(x, HEADER_NAME))
        .withField("receiver", receiver_parts(group(x, HEADER_RECEIVER)))
        .withField("params", field_list(group(x, HEADER_PARAMS)))
        .withField("results", field_list(results(x))),
    )


def spec_parts(items: Column) -> Column:
    """Adds ``specs`` to const/var/type lexemes: one entry per spec, in order, with the
    gaps between them kept as entries whose ``names`` are empty."""

    def cut(item: Column) -> Column:
        whole = F.array(
            F.struct(item["text"].alias("text"), item["comment"].alias("comment"), item["code"].alias("code"))
        )
        body = F.transform(
            F.regexp_extract_all(item["text"], F.lit(SPEC_LEXEME), F.lit(0)),
            lambda text: F.struct(text.alias("text"), F.regexp_extract(text, _LEADING_SPEC_DOC, 1).alias("comment")),
        )
        keyword = F.concat(item["kind"], F.lit(" "))
        body = F.transform(
            body,
            lambda s: s.withField("code", F.substr(s["text"], F.length(s["comment"]) + 1)),
        )
        body = F.transform(
            body,
            lambda s: s.withField(
                "code",
                F.when(
                    s["code"].rlike(rf"\A\t{IDENT}"),
                    F.concat(keyword, F.regexp_replace(s["code"], r"(?md)^\t", "")),
                ).otherwise(F.lit("")),
            ),
        )
        return F.when(item["has_paren"], body).otherwise(whole)

    def parsed(spec: Column, kind: Column) -> Column:
        names = F.regexp_extract(spec["code"], rf"\A(?:const|var|type)[ \t]++({NAMES})", 1)
        value_type = F.regexp_extract(
            spec["code"], rf"(?d)\A(?:const|var)[ \t]++{NAMES}[ \t]*+([^=\n/`\"]*+)", 1
        )
        type_text = F.regexp_extract(
            spec["code"], rf"(?d)\Atype[ \t]++{IDENT}(?:{BRACKET})?+[ \t]*+=?+[ \t]*+([\s\S]*+)\z", 1
        )
        type_text = let(
            F.regexp_replace(type_text, rf"(?d){OPAQUE}", ""),
            lambda t: F.when(F.length(F.regexp_replace(t, r"[^(\[{]++", "")) > DEEPEST, shallow(t, DEEPEST)).otherwise(t),
        )
        return F.struct(
            spec["text"].alias("text"),
            doc_text(spec["comment"]).alias("doc"),
            F.filter(F.split(names, ", *"), lambda n: n != "").alias("names"),
            F.when(kind == "type", type_text).otherwise(value_type).alias("type_text"),
        )

    def described(spec: Column, kind: Column) -> Column:
        is_struct = (kind == "type") & spec["type_text"].rlike(r"\Astruct\b")
        return (
            spec.withField("is_struct", is_struct)
            .withField("type", type_name(spec["type_text"]))
            .withField("fields", F.when(is_struct, struct_fields(spec["type_text"])))
        )

    return F.transform(
        items,
        lambda x: x.withField(
            "specs",
            F.transform(
                F.transform(cut(x), lambda s: parsed(s, x["kind"])),
                lambda s: described(s, x["kind"]),
            ),
        ),
    )


def struct_fields(type_text: Column) -> Column:
    """Named fields as ``array<struct<name, is_ptr>>``; embedded ones are skipped.
    ``type_text`` holds no comments or tags."""
    pattern = rf"(?md)^\t({NAMES})[ \t]++(?=\S)(\*?+)"


    def lines(body: Column) -> Column:
        one_line = F.concat(F.lit("\t"), F.regexp_replace(F.trim(body), r";[ \t]*+", "\n\t"))
        return F.when(body.contains("\n"), body).otherwise(one_line)

    def found(body: Column) -> Column:
        return F.zip_with(
            F.regexp_extract_all(body, F.lit(pattern), F.lit(1)),
            F.regexp_extract_all(body, F.lit(pattern), F.lit(2)),
            lambda n, s: F.transform(
                F.split(n, ", *"), lambda one: F.struct(one.alias("name"), (s == "*").alias("is_ptr"))
            ),
        )

    body = let(F.regexp_extract(type_text, r"\Astruct[ \t]*+\{([\s\S]*)\}", 1), lines)
    return F.flatten(let(body, found))
