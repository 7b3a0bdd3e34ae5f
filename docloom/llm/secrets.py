"""Secret scans: single patterns, and credentials whose parts lie apart.

A part alone (an identifier, a random-looking string, an address) is weak evidence and
is reported only when parts that complete each other stand in one scope.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The single patterns, in the order of their kinds, and the shortest match.
#: ASCII letters only, in either case where the pattern says so.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SINGLE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))

#: Weak parts.  A secret has 20 or more characters of at least three classes.
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|client_?id|access_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+""", re.A)
LINKED = ("identifier", "key", "endpoint")
KIND_ORDER = {kind: n for n, kind in enumerate((*[s[0] for s in SINGLE], *LINKED))}

#: Characters between two parts of one credential, if they are in no block together, and
#: the least entropy of a secret.
SCOPE = 200
ENTROPY = 3.5

Span = tuple[int, int, str]


def single_spans(text: str) -> list[Span]:
    """Matches of the single patterns, leftmost and without overlap within a kind.

    A match that is too short is dropped, not tried again from a later place.
    """
    found = []
    for kind, pattern, group, least in SINGLE:
        for m in pattern.finditer(text):
            begin, end = m.span(group)
            if end - begin >= least:
                found.append((m.start(), m.end(), kind))
    return found


def entropy(text: str) -> float:
    """Bits for each character under the text's own frequencies."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _is_random(text: str) -> bool:
    classes = sum(bool(re.search(c, text)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[+/_=-]"))
    return classes >= 3 and entropy(text) >= ENTROPY


class _Intervals:
    """Places of parts, overlapping ones merged; looks around a place in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans: list[list[int]] = []
        for begin, end in sorted(spans):
            if self.spans and begin < self.spans[-1][1]:
                self.spans[-1][1] = max(end, self.spans[-1][1])
            else:
                self.spans.append([begin, end])
        self.ends = [end for _, end in self.spans]

    def near(self, begin: int, end: int, low: int, high: int) -> bool:
        """Whether a place beside [begin, end), not across it, reaches into [low, high]."""
        at = bisect_left(self.ends, low)
        while at < len(self.spans) and self.spans[at][0] <= high:
            if self.spans[at][1] <= begin or self.spans[at][0] >= end:
                return True
            at += 1
        return False

    def overlap(self, begin: int, end: int) -> bool:
        at = bisect_left(self.ends, begin + 1)
        return at < len(self.spans) and self.spans[at][0] < end


class _Scopes:
    """Blocks of a text: runs of lines that are not blank and not longer than a scope.

    A block begins with a line that ends in an opening bracket and ends with one that
    begins with a closing bracket.  A longer line is prose and in no block.
    """

    def __init__(self, text: str, scope: int):
        self.scope = scope
        self.blocks: list[list[int]] = []
        at, open_ = 0, False
        for line in text.split("\n"):
            end, shown = at + len(line), line.strip(" \t\r\v\f")
            if shown and len(line) <= scope:
                if open_ and not shown.endswith(("{", "[", "(")):
                    self.blocks[-1][1] = end
                else:
                    self.blocks.append([at, end])
                open_ = not shown.startswith(("}", "]", ")"))
            else:
                open_ = False
            at = end + 1
        self.begins = [begin for begin, _ in self.blocks]

    def around(self, begin: int, end: int) -> tuple[int, int]:
        """The block that holds [begin, end), or ``scope`` characters to both sides if that is wider."""
        low, high = begin - self.scope, end + self.scope
        at = bisect_right(self.begins, begin) - 1
        if at >= 0 and end <= self.blocks[at][1]:
            low, high = min(low, self.blocks[at][0]), max(high, self.blocks[at][1])
        return low, high


def linked_spans(text: str, single: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak parts with a complementary part, weak or already found, in one scope.

    A scope is the block of lines that holds a part, or ``scope`` characters to both
    sides, whichever is wider.

    An identifier or an endpoint needs a secret; a secret needs one of those two or an
    access key.  The parts of a kind do not overlap, so each looks for the first in its scope
    only and no pairs are listed.
    """
    ids = [m.span() for m in IDENTIFIER.finditer(text)]
    places = [m.span() for m in ENDPOINT.finditer(text)]
    if not (ids or places or any(kind == "access" for _, _, kind in single)):
        return []
    taken = _Intervals([(b, e) for b, e, _ in single] + ids + places)
    keys = [m.span() for m in SECRET.finditer(text) if not taken.overlap(*m.span()) and _is_random(m[0])]
    secrets = _Intervals(keys + [(b, e) for b, e, kind in single if kind in ("assign", "hex")])
    partners = _Intervals(ids + places + [(b, e) for b, e, kind in single if kind == "access"])
    scopes = _Scopes(text, scope)
    found = [(b, e, "identifier") for b, e in ids if secrets.near(b, e, *scopes.around(b, e))]
    found += [(b, e, "key") for b, e in keys if partners.near(b, e, *scopes.around(b, e))]
    found += [(b, e, "endpoint") for b, e in places if secrets.near(b, e, *scopes.around(b, e))]
    return found


def all_spans(text: str | None, scope: int = SCOPE) -> list[Span]:
    """Every span of a text by start, then kind in the order listed."""
    single = single_spans(text or "")
    spans = single + linked_spans(text or "", single, scope)
    return sorted(spans, key=lambda s: (s[0], KIND_ORDER[s[2]], s[1]))


SPANS = "array<struct<begin: int, end: int, kind: string>>"


def find_secrets(docs: DataFrame, text: str = "text", id_column: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row for each document: id and ``spans`` (begin, end, kind), in code points.

    Parts are linked inside a document only, so nothing is shuffled and a source or a
    group of copies cannot make a task large.  Null and empty texts have no spans.
    Repeated rows and null ids stay as they are; other columns are ignored; an empty
    table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            rows = [[{"begin": b, "end": e, "kind": k} for b, e, k in all_spans(t.as_py(), scope)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], ["id", "spans"])

    chosen = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(scan, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_column)
