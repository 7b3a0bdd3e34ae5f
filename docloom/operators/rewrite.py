"""Commented files: place drafts before declarations, list the changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import golang, patches, templates
from docloom.functions.golayout import readable
from docloom.functions.once import let, with_once
from docloom.operators.filters import changed, is_entry_point


def _ends_line(text: Column) -> Column:
    return let(
        text, lambda t: F.when((t == "") | t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))
    )


def _function_draft(
    decl: Column, pos: Column, signature: Column, with_example: Column, replies: Column | None
) -> Column:
    skip = (decl["name"] == "") | (decl["doc"] != "") | is_entry_point(decl["name"])
    if replies is None:
        text = templates.function_comment(decl, with_example)
    else:
        text = templates.slash_lines(F.element_at(replies, pos))
    draft = F.concat(text, templates.author_line(signature))
    return F.when(skip, F.lit("")).otherwise(F.coalesce(_ends_line(draft), F.lit("")))


def _entries(
    content: Column, signature: Column | None, with_example: Column | None, replies: Column | None, draft_values: Column | None
) -> Column:
    """The file in order as ``array<struct<at, sub, draft, text>>``: the texts joined are the
    file, a draft goes before its text."""
    signature = F.lit(None).cast("string") if signature is None else signature
    with_example = F.lit(False) if with_example is None else with_example
    draft_values = F.lit(True) if draft_values is None else draft_values

    def entry(at: Column, sub: Column, draft: Column, text: Column) -> Column:
        return F.struct(at.alias("at"), sub.alias("sub"), draft.alias("draft"), text.alias("text"))

    def of_specs(item: Column) -> Column:
        indent = F.when(item["has_paren"], F.lit("\t")).otherwise(F.lit(""))

        def placed(spec: Column, sub: Column) -> Column:
            text = templates.spec_comment(item["kind"], spec, item["has_paren"], signature)
            draft = _ends_line(F.when(draft_values | (item["kind"] == "type"), text).otherwise(F.lit("")))
            return entry(item["at"], sub, F.regexp_replace(draft, F.lit(r"(?m)^(?!\z)"), indent), spec["text"])

        return F.transform(item["specs"], placed)

    # Functions and other declarations go through their own parsers; both keep their
    # place in the file and meet again in order.
    def ordered(items: Column) -> Column:
        none = F.lit(0)
        functions = F.transform(
            golang.function_parts(F.filter(items, lambda x: x["kind"] == "func")),
            lambda d, pos: entry(d["at"], none, _function_draft(d, pos, signature, with_example, replies), d["text"]),
        )
        specs = golang.spec_parts(F.filter(items, lambda x: x["kind"].isin("const", "var", "type")))
        rest = F.transform(F.filter(items, lambda x: x["kind"] == ""), lambda x: entry(x["at"], none, F.lit(""), x["text"]))
        return F.array_sort(F.concat(functions, F.flatten(F.transform(specs, of_specs)), rest))

    items = golang.lexeme_parts(golang.lexemes(content))
    return let(F.transform(items, lambda x, i: x.withField("at", i)), ordered)


def commented(
    files: DataFrame,
    content: str = "content",
    signature: Column | None = None,
    with_example: Column | None = None,
    replies: Column | None = None,
    draft_values: Column | None = None,
) -> DataFrame:
    """Adds ``new_content``: a template comment before every undocumented declaration.

    With ``replies``, a map from a function's place among the functions of its file to a
    model's comment, functions get that instead, and those without one get none.
    Constants and variables get a comment where ``draft_values`` holds (by default
    everywhere).

    Files that do not parse, and files that need nothing, keep their text.  Existing
    comments stay where they are.  The work is one chain of array transforms per file:
    the lexemes are joined again with the drafts in between, without a shuffle.
    """
    entries = _entries(F.col(content), signature, with_example, replies, draft_values)

    # A file without a draft stays as it is, line ends included.
    def joined(found: Column) -> Column:
        text = F.array_join(F.transform(found, lambda e: F.concat(e["draft"], e["text"])), "")
        return F.when(F.exists(found, lambda e: e["draft"] != ""), text).otherwise(F.col(content))

    parsed = F.coalesce(golang.parses(F.col(content)), F.lit(False))
    return with_once(files, "new_content", F.when(parsed, let(entries, joined)).otherwise(F.col(content)))


def _changes(content: Column, signature: Column | None, with_example: Column | None) -> Column:
    """``array<struct<line, text>>``: texts that go before lines of the laid-out file."""

    def placed(found: Column) -> Column:
        lines = F.transform(found, lambda e: F.length(e["text"]) - F.length(F.replace(e["text"], F.lit("\n"), F.lit(""))))
        begins = F.aggregate(
            lines, F.array(F.lit(1)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n))
        )
        with_lines = let(begins, lambda b: F.transform(found, lambda e, k: F.struct(F.get(b, k).alias("line"), e["draft"].alias("text"))))
        return F.filter(with_lines, lambda e: e["text"] != "")

    return let(_entries(content, signature, with_example, None, None), placed)


def _parsed(files: DataFrame, content: str) -> DataFrame:
    return files.filter(F.coalesce(golang.parses(F.col(content)), F.lit(False)))


def inserted_comments(
    files: DataFrame, content: str = "content", signature: Column | None = None, with_example: Column | None = None
) -> DataFrame:
    """The changes that ``commented`` makes, as ``(..., line, text)``: the text goes before
    that line (from 1) of the file with plain line feeds, in the layout that is read."""
    others = [c for c in files.columns if c != content]
    found = _parsed(files, content).select(*others, F.explode(_changes(F.col(content), signature, with_example)).alias("_change"))
    return found.select(*others, "_change.line", "_change.text")


def file_patches(
    files: DataFrame, content: str = "content", signature: Column | None = None, with_example: Column | None = None
) -> DataFrame:
    """The changed files with ``patch``, a unified patch from ``content`` to what ``commented``
    makes of it.  A file that was laid out again, or had other line ends, is replaced whole."""
    text = F.col(content)
    laid = with_once(_parsed(files, content), "_laid", readable(golang.unix_lines(text)))
    found = with_once(laid, "_changes", _changes(text, signature, with_example)).filter(F.size("_changes") > 0)
    inserted = with_once(found, "_patch", patches.insertion_patch(F.col("path"), F.col("_laid"), F.col("_changes")))
    whole = patches.replacement_patch(F.col("path"), text, patches.apply_patch(F.col("_laid"), F.col("_patch")))
    return inserted.withColumn("patch", F.when(F.col("_laid") == text, F.col("_patch")).otherwise(whole)).drop("_laid", "_changes", "_patch")


def patched(files: DataFrame, content: str = "content", patch: str = "patch") -> DataFrame:
    """Adds ``new_content``: the file with its patch applied, null if the patch does not fit."""
    return files.withColumn("new_content", patches.apply_patch(F.col(content), F.col(patch)))


def changed_paths(files: DataFrame) -> DataFrame:
    return changed(files).select("path")
