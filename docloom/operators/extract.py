"""Files to rows: functions, declarations, token-stream pairs and fenced snippets.

Every operator is narrow.  A file's declarations live in one array column until
the final ``posexplode``, so a repository or folder that holds most of the corpus
costs no skewed shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import golang
from docloom.functions.gotokens import last_comment_pairs
from docloom.functions.naming import is_exported
from docloom.functions.once import let
from docloom.functions.text import fenced_code
from docloom.operators.filters import (
    has_ignored_annotation,
    has_ignored_keyword,
    is_entry_point,
    parsable,
)


def _others(df: DataFrame, *dropped: str) -> list[str]:
    return [c for c in df.columns if c not in dropped]


def _lexemes(content: str = "content") -> Column:
    return golang.lexeme_parts(golang.lexemes(F.col(content)))


def functions(files: DataFrame) -> DataFrame:
    """All functions: ``(..., pos, name, signature, doc, receiver, params, results)``."""
    keep = _others(files, "content")
    found = (
        parsable(files)
        # The generator also keeps later predicates from inlining the parsing.
        .select(
            *keep,
            F.posexplode(
                golang.function_parts(F.filter(_lexemes(), lambda x: x["kind"] == "func"))
            ).alias("pos", "decl"),
        )
        .filter(F.col("decl.name") != "")
    )
    decl = F.col("decl")
    return found.select(
        *keep, "pos", "decl.name", golang.signature(decl).alias("signature"),
        "decl.doc", "decl.receiver", "decl.params", "decl.results",
    )


def function_pairs(files: DataFrame) -> DataFrame:
    """Documented functions as ``(..., pos, name, comment)``; ``name`` is the rendered
    signature.  Entry points and comments with an ignored keyword are left out."""
    keep = _others(files, "content")
    return (
        functions(files)
        .filter((F.col("doc") != "") & ~is_entry_point(F.col("name")))
        .filter(~has_ignored_keyword(F.col("doc")))
        .select(*keep, "pos", F.col("signature").alias("name"), F.col("doc").alias("comment"))
    )


def undocumented_functions(files: DataFrame) -> DataFrame:
    return functions(files).filter((F.col("doc") == "") & ~is_entry_point(F.col("name")))


def value_and_type_specs(files: DataFrame) -> DataFrame:
    """const/var/type specs: ``(..., pos, spec_pos, kind, has_paren, spec)``."""
    keep = _others(files, "content")
    return (
        parsable(files)
        .select(
            *keep,
            F.posexplode(
                golang.spec_parts(F.filter(_lexemes(), lambda x: x["kind"].isin("const", "var", "type")))
            ).alias("pos", "item"),
        )
        .select(*keep, "pos", "item.kind", "item.has_paren", F.posexplode("item.specs").alias("spec_pos", "spec"))
        .filter(F.size("spec.names") > 0)
    )


def declarations(files: DataFrame) -> DataFrame:
    """All declarations in one pass, one row per declared name:
    ``(..., pos, kind, name, has_paren, doc, type, fields, exported)``.

    ``pos`` is the place of the declaration in its file; the names of a group share it.
    """
    no_fields = F.lit(None).cast("array<struct<name: string, is_ptr: boolean>>")

    def row(item: Column, kind: Column, name: Column, has_paren: Column, doc: Column, kind_text: Column, fields: Column):
        return F.struct(
            item["at"].alias("pos"), kind.alias("kind"), name.alias("name"), has_paren.alias("has_paren"),
            doc.alias("doc"), kind_text.alias("type"), fields.alias("fields"),
        )

    def spec_rows(item: Column) -> Column:
        return F.flatten(
            F.transform(
                item["specs"],
                lambda s: F.transform(
                    s["names"],
                    lambda n: row(item, item["kind"], n, item["has_paren"], s["doc"], s["type"], s["fields"]),
                ),
            )
        )

    def rows(items: Column) -> Column:
        funcs = golang.function_parts(F.filter(items, lambda x: x["kind"] == "func"))
        specs = golang.spec_parts(F.filter(items, lambda x: x["kind"].isin("const", "var", "type")))
        return F.concat(
            F.transform(
                F.filter(funcs, lambda d: d["name"] != ""),
                lambda d: row(d, F.lit("func"), d["name"], F.lit(False), d["doc"], golang.signature(d), no_fields),
            ),
            F.flatten(F.transform(specs, spec_rows)),
        )

    numbered = F.transform(_lexemes(), lambda x, i: x.withField("at", i))
    found = parsable(files).select(*_others(files, "content"), F.explode(let(numbered, rows)).alias("decl"))
    return found.select(*_others(files, "content"), "decl.*").withColumn("exported", is_exported(F.col("name")))


def undocumented(decls: DataFrame) -> DataFrame:
    """Declarations without a comment; of functions, entry points are left out."""
    return decls.filter(
        (F.coalesce(F.col("doc"), F.lit("")) == "")
        & ~((F.col("kind") == "func") & is_entry_point(F.col("name")))
    )


def token_stream_pairs(files: DataFrame, keep_all: bool = False) -> DataFrame:
    """``(..., pos, name, comment)`` by the last comment seen before each name.

    ``keep_all`` keeps functions without a comment and ignored annotations.
    """
    keep = _others(files, "content")
    pairs = files.select(*keep, F.posexplode(last_comment_pairs(F.col("content"))).alias("pos", "pair")).select(
        *keep, "pos", "pair.name", "pair.comment"
    )
    if keep_all:
        return pairs
    return pairs.filter(F.col("comment").isNotNull() & ~has_ignored_annotation(F.col("comment")))


def fenced_snippets(pages: DataFrame, content: str = "payload") -> DataFrame:
    """One row per fenced Go block; pages without one drop out."""
    keep = _others(pages, content)
    return pages.select(*keep, F.posexplode(fenced_code(F.col(content))).alias("pos", "snippet"))


def snippet_lists(pages: DataFrame, content: str = "payload") -> DataFrame:
    """The same blocks as one array per page; pages without one keep an empty array."""
    return pages.withColumn("snippets", fenced_code(F.col(content))).drop(content)
