"""Comment analysis and grading without a shuffle.

A comment is tokenised and tagged inside its own row.  Word classes come from a
lexicon (below, or any ``Lexicon``) plus suffix rules; sets are tested with
``isin``, which Spark evaluates as a hash-set probe.  For a lexicon too large to
be a literal, see ``operators.analysis.analyze_with_lexicon``.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]++|\n++|[^\p{L}\p{N}_\s]"

# Technical terms of programming; a graded comment needs one.
TECH_TERMS = (
    "initialize", "compute", "return", "calculate", "set", "get", "create",
    "update", "delete", "process", "validate", "parse", "fetch", "store",
    "modify", "load", "save", "convert", "render", "transform", "execute",
    "query", "sync", "merge", "send", "receive", "configure", "build",
    "handle", "optimize", "resolve", "map", "filter", "sort", "aggregate",
    "serialize", "deserialize", "log", "debug", "trace", "flush", "connect",
    "disconnect", "authenticate", "authorize",
)
# Grade thresholds.
MIN_TOKENS = 5
MIN_VERBS = 1
MAX_STOP_SHARE = 0.5
MIN_TECH_TERMS = 1

CLOSED_CLASSES = {
    "DET": "the a an this that these those each every some any no all both another".split(),
    "PRON": "i you he she it we they me him her us them who which what its his their our your my".split(),
    "ADP": "of in on at by for with from into over under between through about after before as against via".split(),
    "CCONJ": "and or but nor".split(),
    "SCONJ": "if because while when whether although since unless until".split(),
    "AUX": (
        "is are was were be been being am has have had do does did can could will would shall should may might must"
    ).split(),
    "PART": "to not".split(),
    "ADV": "then there here now very also only just too so again once how where why".split(),
}
VERBS = TECH_TERMS + tuple(
    "add append apply assign attach call change check clean clear close collect compare contain copy count "
    "decode define describe detect determine drop encode ensure exit extract find format generate give hold "
    "implement include increment indicate insert iterate join keep list lock make mark match move need open "
    "pass perform print provide put read register release remove replace report represent request require "
    "reset retrieve run scan search select show skip split start stop support take test try unlock use wait "
    "want watch wrap write".split()
)
IRREGULAR_LEMMAS = {
    "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be", "am": "be",
    "has": "have", "had": "have", "does": "do", "did": "do", "made": "make", "sent": "send",
    "built": "build", "got": "get", "gave": "give", "given": "give", "took": "take", "taken": "take",
    "found": "find", "kept": "keep", "held": "hold", "ran": "run", "wrote": "write", "written": "write",
    "an": "a", "these": "this", "those": "that",
}
ASCII_MARKS = tuple(c for c in string.punctuation if c != "_")
DATE_WORDS = (
    "January February March April May June July August September October November December "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday"
).split()


@dataclass(frozen=True)
class Lexicon:
    """Word lists of the analysis; every list is a literal in the plan."""

    closed: dict[str, list[str]] = field(default_factory=lambda: CLOSED_CLASSES)
    verbs: tuple[str, ...] = VERBS
    lemmas: dict[str, str] = field(default_factory=lambda: IRREGULAR_LEMMAS)
    entities: dict[str, str] = field(default_factory=lambda: {w: "DATE" for w in DATE_WORDS})
    tech_terms: tuple[str, ...] = TECH_TERMS

    @property
    def stop_words(self) -> list[str]:
        return sorted({word for words in self.closed.values() for word in words})


DEFAULT_LEXICON = Lexicon()


def tokens(comment: Column) -> Column:
    """Words, runs of line feeds and single punctuation marks; all count toward length."""
    return F.regexp_extract_all(comment, F.lit(TOKEN), F.lit(0))


# The tagging rules are SQL text: word lists are long, and as text a list is one call.


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _one_of(value: str, words) -> str:
    return f"{value} IN ({', '.join(_text(w) for w in words)})" if words else "false"


def _mapped(key: str, values: dict[str, str]) -> str:
    pairs = ", ".join(f"{_text(k)}, {_text(v)}" for k, v in values.items())
    return f"element_at(map({pairs}), {key})" if values else "CAST(NULL AS STRING)"


def lemma_rule(word: str, lexicon: Lexicon = DEFAULT_LEXICON) -> str:
    """Base form of a lower-cased word: listed form, else suffix rules whose candidates
    are tried against the verb list.  Most words end in no suffix and leave early."""
    irregular = {form: base for form, base in lexicon.lemmas.items() if form not in lexicon.verbs}
    listed = sorted({*lexicon.verbs, *lexicon.lemmas, *lexicon.stop_words})

    def verb(value: str) -> str:
        return _one_of(value, lexicon.verbs)

    def cut(n: int, value: str = word) -> str:
        return f"left({value}, length({value}) - {n})"

    def undo(stem: str) -> str:
        return (
            f"CASE WHEN {verb(stem)} THEN {stem} WHEN {verb(f'concat({stem}, {_text("e")})')} THEN concat({stem}, 'e') "
            f"WHEN right({stem}, 1) = left(right({stem}, 2), 1) AND {verb(cut(1, stem))} THEN {cut(1, stem)} "
            f"ELSE {stem} END"
        )

    return (
        f"CASE WHEN {_one_of(word, listed)} THEN coalesce(IF({_one_of(word, irregular)}, {_mapped(word, irregular)}, NULL), {word}) "
        f"WHEN right({word}, 1) NOT IN ('s', 'g', 'd') THEN {word} "
        f"WHEN endswith({word}, 'ing') THEN IF(length({word}) > 5, {undo(cut(3))}, {word}) "
        f"WHEN endswith({word}, 'ed') THEN IF(length({word}) > 4, {undo(cut(2))}, {word}) "
        f"WHEN right({word}, 1) <> 's' THEN {word} "
        f"WHEN {verb(cut(1))} THEN {cut(1)} "
        f"WHEN endswith({word}, 'es') AND {verb(cut(2))} THEN {cut(2)} "
        f"WHEN endswith({word}, 'ies') AND length({word}) > 4 THEN concat({cut(3)}, 'y') "
        f"WHEN length({word}) <= 3 OR right({word}, 2) IN ('ss', 'us', 'is') THEN {word} "
        f"ELSE {cut(1)} END"
    )


def pos_rule(text: str, word: str, base: str, lexicon: Lexicon = DEFAULT_LEXICON) -> str:
    """Coarse tag of a token: closed class, digits, marks, verb by list or suffix, else NOUN.

    A token that starts with an ASCII letter is neither digits nor a mark; the patterns
    are left to the few others.
    """
    listed = sorted({*lexicon.verbs, *lexicon.lemmas, *lexicon.stop_words})
    closed = " ".join(f"WHEN {_one_of(word, words)} THEN {_text(tag)}" for tag, words in lexicon.closed.items())
    # An unlisted word without one of these endings is its own lemma, hence no verb.
    open_class = (
        f"CASE WHEN right({word}, 1) NOT IN ('g', 'd', 's', 'y') THEN 'NOUN' "
        f"WHEN endswith({word}, 'ing') AND length({word}) > 5 THEN 'VERB' "
        f"WHEN endswith({word}, 'ed') AND length({word}) > 4 THEN 'VERB' WHEN {_one_of(base, lexicon.verbs)} THEN 'VERB' "
        f"WHEN endswith({word}, 'ly') AND length({word}) > 4 THEN 'ADV' ELSE 'NOUN' END"
    )
    return (
        f"CASE WHEN {_one_of(word, listed)} THEN CASE {closed} ELSE 'VERB' END "
        f"WHEN {word} >= 'a' AND {word} < '{{' THEN {open_class} "
        f"WHEN {_one_of(text, ASCII_MARKS)} THEN 'PUNCT' WHEN startswith({text}, '\\n') THEN 'SPACE' "
        f"WHEN {text} RLIKE {_text(_DIGITS)} THEN 'NUM' WHEN {text} RLIKE {_text(_MARK)} THEN 'PUNCT' "
        f"ELSE {open_class} END"
    )


_DIGITS = r"^\p{Nd}++$"
_MARK = r"^[^\p{L}\p{N}_]$"


def tagged(comment: str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """``array<struct<text, word, lemma, pos>>`` of the named comment column; a null comment has no items."""
    split = f"transform(regexp_extract_all(coalesce({comment}, ''), {_text(TOKEN)}, 0), t -> struct(t AS text, lower(t) AS word))"
    based = (
        f"transform({split}, x -> struct(x.text AS text, x.word AS word, {lemma_rule('x.word', lexicon)} AS lemma))"
    )
    return F.expr(
        f"transform({based}, x -> struct(x.text AS text, x.word AS word, x.lemma AS lemma, "
        f"{pos_rule('x.text', 'x.word', 'x.lemma', lexicon)} AS pos))"
    )


def analysis(items: str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """The stored analysis: tokens, lemmas, tags and entities of ``tagged`` items."""
    entity = f"x.pos = 'NUM' OR {_one_of('x.text', lexicon.entities)}"
    label = f"coalesce({_mapped('x.text', lexicon.entities)}, 'CARDINAL')"
    return F.expr(
        f"struct({items}.text AS tokens, {items}.lemma AS lemmas, {items}.pos AS pos_tags, "
        f"transform(filter({items}, x -> {entity}), x -> struct(x.text AS text, {label} AS label)) AS entities)"
    )


# Bits of a word's role.
IS_VERB, IS_STOP, IS_TECH = 1, 2, 4


def role_rule(word: str, lexicon: Lexicon = DEFAULT_LEXICON) -> str:
    """Role bits of a lower-cased word: what the tag and lemma rules say about it, without
    building either.  The roles of listed words are known beforehand."""
    stop, closed = set(lexicon.stop_words), set(lexicon.stop_words)
    listed = {*lexicon.verbs, *lexicon.lemmas, *stop}
    by_role: dict[int, list[str]] = {}
    for entry in sorted(listed):
        base = entry if entry in lexicon.verbs else lexicon.lemmas.get(entry, entry)
        role = IS_STOP * (entry in stop) + IS_VERB * (entry not in closed) + IS_TECH * (base in lexicon.tech_terms)
        by_role.setdefault(role, []).append(entry)
    known = " ".join(f"WHEN {_one_of(word, entries)} THEN {role}" for role, entries in by_role.items())
    other_terms = sorted(set(lexicon.tech_terms) - listed)
    suffixed = (
        f"element_at(transform(array({lemma_rule(word, lexicon)}), base -> "
        f"IF(endswith({word}, 'ing') AND length({word}) > 5 OR endswith({word}, 'ed') AND length({word}) > 4 "
        f"OR {_one_of('base', lexicon.verbs)}, {IS_VERB}, 0) + IF({_one_of('base', lexicon.tech_terms)}, {IS_TECH}, 0)), 1)"
    )
    return (
        f"CASE {known} WHEN right({word}, 1) NOT IN ('s', 'g', 'd') THEN IF({_one_of(word, other_terms)}, {IS_TECH}, 0) "
        f"ELSE {suffixed} END"
    )


def roles(comment: str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """``array<int>``: role bits of every token of the named comment column; none for a null."""
    lowered = f"transform(regexp_extract_all(coalesce({comment}, ''), {_text(TOKEN)}, 0), t -> lower(t))"
    return F.expr(f"transform({lowered}, w -> {role_rule('w', lexicon)})")


def counts(role_array: str) -> Column:
    """Counts of the named ``roles`` column."""

    def count(bit: int) -> str:
        return f"size(filter({role_array}, r -> r & {bit} > 0))"

    return F.expr(
        f"struct(size({role_array}) AS n_tokens, {count(IS_VERB)} AS n_verbs, "
        f"{count(IS_STOP)} AS n_stop, {count(IS_TECH)} AS n_tech)"
    )


def grade(n_tokens: Column, n_verbs: Column, n_stop: Column, n_tech: Column) -> Column:
    """The order of the tests matters."""
    return (
        F.when(n_tokens < MIN_TOKENS, F.lit("poor"))
        .when(n_verbs < MIN_VERBS, F.lit("poor"))
        .when(n_stop > n_tokens * MAX_STOP_SHARE, F.lit("average"))
        .when(n_tech < MIN_TECH_TERMS, F.lit("average"))
        .otherwise(F.lit("good"))
    )
