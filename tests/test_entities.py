"""Gazetteer names of several words: from the left, the longest first."""

from __future__ import annotations

import random
import re

from docloom.operators.entities import entity_spans


def brute(text, names):
    w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    out, at = [], 0
    while at < len(w):
        found = [n for n in range(1, min(5, len(w) - at) + 1) if " ".join(w[at : at + n]) in names]
        if found:
            name = " ".join(w[at : at + found[-1]])
            out.append((at, at + found[-1], name, names[name]))
            at += found[-1]
        else:
            at += 1
    return out


def test_spans_match_a_walk_over_the_words(spark):
    rng = random.Random(2)
    names = {}
    for _ in range(60):
        names.setdefault(" ".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))), rng.choice(["PER", "LOC"]))
    gazetteer = spark.createDataFrame(
        [(n.replace(" ", ", "), lab) for n, lab in names.items()] + [(n, "ZZZ") for n in list(names)[:5]] + [(None, "X"), ("...", "X"), ("q q", None)],
        "name string, label string",
    )
    texts = [" ".join(rng.choice("abcdeéfgh") for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, "", "a-b. A B", "q q", "a b " * 3000]
    rows = [(i if i % 7 else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "begin int, text string, label string").repartition(4)
    got = sorted((tuple(r) for r in entity_spans(docs, gazetteer, ["begin"]).toDF("id", "b", "e", "name", "label").collect()), key=str)
    want = {(i, t): [(i, *s) for s in brute(t, names)] for i, t, _ in rows}
    assert got == sorted((s for spans in want.values() for s in spans), key=str)
    assert entity_spans(docs, gazetteer.limit(0), ["begin"]).count() == 0
    assert entity_spans(docs.limit(0), gazetteer, ["begin"]).count() == 0
