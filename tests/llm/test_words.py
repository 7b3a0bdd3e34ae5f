from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm.fm_index import FMIndex, suffix_array
from docloom.llm.words import LETTER_DIGIT, NOT_SPACE, range_hashes, slices, split_words, window_hashes

CASES = [["a b", None, "", "  c", "Ünïcode—dash x9\n", "AbC"], [None], [], ["", ""], ["x"], ["a", "b"]]


@pytest.mark.parametrize("texts", CASES)
@pytest.mark.parametrize(("inside", "pattern"), [(NOT_SPACE, r"[^\x20\x09-\x0D]+"), (LETTER_DIGIT, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_are_those_of_the_pattern(texts, inside, pattern):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = split_words(pa.array(texts, pa.string()), inside)
    for row, text in enumerate(texts):
        own = [found.text(i).decode() for i in range(found.first[row], found.first[row + 1])]
        assert own == re.findall(pattern, (text or "").translate(lower))


def test_hashes_follow_the_bytes_only():
    found = split_words(pa.array(["ab cd ab", "ab", "ba" * 5000]), NOT_SPACE)
    h = range_hashes(found.data, found.start, found.end)
    assert h[0] == h[2] == h[3]
    assert len(set(h.tolist())) == 3
    pair = window_hashes(h, 2)
    assert pair[0] != pair[1]


def test_slices_cover_all_rows_in_order():
    column = pa.array(["a" * n for n in (5, 1, 20, 0, 3, 3)] + [None])
    found = list(slices(column, 6))
    assert [a for a, _ in found] == [0, *[b for _, b in found[:-1]]]
    assert found[-1][1] == 7
    assert (2, 4) in found or (2, 3) in found


def test_suffix_array_and_search_find_every_occurrence():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 400)
    full = np.concatenate([text, [0]])
    assert suffix_array(full).tolist() == sorted(range(401), key=lambda i: full[i:].tolist())
    index = FMIndex(text, 4)
    phrases = rng.integers(1, 4, (60, 4))
    which, low, high = index.search(phrases)
    owner, start = index.locate(low, high)
    got = sorted(zip(which[owner].tolist(), start.tolist(), strict=True))
    want = sorted((p, i) for p in range(60) for i in range(397) if (text[i : i + 4] == phrases[p]).all())
    assert got == want
