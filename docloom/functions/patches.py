"""Unified patches of files into which whole lines are inserted, as columns.

Insertions that stand close together share a hunk: a session ends where the gap to the next
one is wider than the context of both.  A hunk's header follows from the running number of
lines that earlier hunks have added.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.once import let

#: Lines of the file around a change.
CONTEXT = 3
_CHANGES = "array<struct<line: int, text: string>>"
NO_LINE_END = "\\ No newline at end of file"


def file_lines(text: Column) -> Column:
    """The lines without their ends; an empty text has none."""
    whole = F.when(text.endswith("\n"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\n", -1))


def _sessions(changes: Column) -> Column:
    """Changes in order to ``array<array<change>>``, cut at gaps wider than two contexts."""

    def add(done: Column, change: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = change["line"] - F.element_at(last, -1)["line"] <= 2 * CONTEXT
        one = F.array(change)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, one)))
        return F.when((F.size(done) > 0) & near, joined).otherwise(F.concat(done, F.array(one)))

    return F.aggregate(changes, F.array().cast(f"array<{_CHANGES}>"), add)


def _count(session: Column) -> Column:
    return F.aggregate(session, F.lit(0), lambda n, c: n + F.size(file_lines(c["text"])))


def _hunk(session: Column, lines: Column, added: Column, open_end: Column) -> Column:
    n = F.size(lines)
    begin = F.greatest(F.lit(1), F.element_at(session, 1)["line"] - CONTEXT)
    end = F.least(n, F.element_at(session, -1)["line"] + CONTEXT - 1)
    header = F.format_string(
        "@@ -%d,%d +%d,%d @@", begin, end - begin + 1, begin + added, end - begin + 1 + _count(session)
    )

    def body(number: Column) -> Column:
        here = F.flatten(F.transform(F.filter(session, lambda c: c["line"] == number), lambda c: file_lines(c["text"])))
        context = F.concat(F.lit(" "), F.get(lines, number - 1))
        ended = F.when((number == n) & open_end, F.array(context, F.lit(NO_LINE_END))).otherwise(F.array(context))
        return F.concat(F.transform(here, lambda x: F.concat(F.lit("+"), x)), ended)

    rows = F.concat(F.array(header), F.flatten(F.transform(F.sequence(begin, end), body)))
    return F.concat(F.array_join(rows, "\n"), F.lit("\n"))


def _head(path: Column) -> Column:
    return F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"))


def insertion_patch(path: Column, text: Column, changes: Column) -> Column:
    """The patch that puts each change's text before its line (from 1); '' if there is none.

    Changes are in order of lines, at most one a line, and their texts end with a line feed.
    """

    def hunks(sessions: Column, lines: Column) -> Column:
        begins = F.aggregate(
            sessions, F.array(F.lit(0)), lambda done, s: F.concat(done, F.array(F.element_at(done, -1) + _count(s)))
        )
        return let(
            begins,
            lambda added: F.array_join(F.transform(sessions, lambda s, i: _hunk(s, lines, F.get(added, i), ~text.endswith("\n"))), ""),
        )

    made = let(_sessions(changes.cast(_CHANGES)), lambda sessions: let(file_lines(text), lambda lines: hunks(sessions, lines)))
    return F.when(F.size(changes) > 0, F.concat(_head(path), made)).otherwise(F.lit(""))


def replacement_patch(path: Column, old: Column, new: Column) -> Column:
    """The patch that replaces a whole file, for one whose lines have been laid out again."""

    def side(text: Column, mark: str) -> Column:
        marked = F.transform(file_lines(text), lambda x: F.concat(F.lit(mark), x))
        return F.when(text.endswith("\n") | (text == ""), marked).otherwise(F.concat(marked, F.array(F.lit(NO_LINE_END))))

    n, m = F.size(file_lines(old)), F.size(file_lines(new))
    header = F.format_string("@@ -%d,%d +%d,%d @@", F.least(n, F.lit(1)), n, F.least(m, F.lit(1)), m)
    rows = F.concat(F.array(header), side(old, "-"), side(new, "+"))
    return F.concat(_head(path), F.array_join(rows, "\n"), F.lit("\n"))


def apply_patch(text: Column, patch: Column) -> Column:
    """The text with a unified patch of its file applied; null if a context or removed line differs."""
    hunk = r"(?m)^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@[^\n]*\n((?:^[ +\\-][^\n]*(?:\n|\z))*+)"

    def parts() -> Column:
        begins, counts, bodies = (F.regexp_extract_all(patch, F.lit(hunk), F.lit(g)) for g in (1, 2, 3))
        numbered = F.zip_with(begins, counts, lambda b, c: F.struct(b.cast("int").alias("begin"), F.when(c == "", 1).otherwise(c.try_cast("int")).alias("n")))
        return F.zip_with(
            numbered, bodies,
            lambda h, b: F.struct(F.when(h["n"] == 0, h["begin"] + 1).otherwise(h["begin"]).alias("begin"), h["n"].alias("n"), file_lines(b).alias("rows")),
        )

    def of(rows: Column, marks: str) -> Column:
        return F.transform(F.filter(rows, lambda x: x.rlike(rf"\A[{marks}]")), lambda x: F.substr(x, F.lit(2)))

    def joined(hunks: Column, lines: Column) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("fits"))

        def step(done: Column, h: Column) -> Column:
            kept = F.slice(lines, done["at"], F.greatest(h["begin"] - done["at"], F.lit(0)))
            fits = done["fits"] & (F.slice(lines, h["begin"], h["n"]) == of(h["rows"], " -"))
            return F.struct((h["begin"] + h["n"]).alias("at"), F.concat(done["out"], kept, of(h["rows"], " +")).alias("out"), fits.alias("fits"))

        def end(done: Column) -> Column:
            out = F.concat(done["out"], F.slice(lines, done["at"], F.greatest(F.size(lines) - done["at"] + 1, F.lit(0))))
            # The mark of an open end counts where it follows a line that is in the new file.
            marked = patch.rlike(rf"(?m)^[ +][^\n]*\n\{NO_LINE_END}")
            whole = F.array_join(out, "\n")
            closed = F.when(F.size(out) == 0, F.lit("")).otherwise(F.concat(whole, F.lit("\n")))
            untouched = (done["at"] <= F.size(lines)) & ~text.endswith("\n")
            return F.when(done["fits"], F.when(marked | untouched, whole).otherwise(closed))

        return F.aggregate(hunks, start, step, end)

    return F.when(patch == "", text).otherwise(let(parts(), lambda hunks: let(file_lines(text), lambda lines: joined(hunks, lines))))
