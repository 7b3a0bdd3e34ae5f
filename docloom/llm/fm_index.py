"""An FM-index over a sequence of small integers, searched for many phrases at once."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the compared length.

    The first sort compares as many symbols as fit into 63 bits; after that only suffixes
    that are still equal to another are sorted again, inside their group.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    width = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: max(0, n - k)] |= symbols[k:]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    active = np.arange(n)
    ordered = key[order]
    while True:
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        # A group's rank is the place where it begins.
        rank[order[active]] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        active = active[~(new & np.concatenate([new[1:], [True]]))]
        if not len(active):
            return order
        suffix = order[active]
        later = np.where(suffix + width < n, rank[np.minimum(suffix + width, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + later
        sort = np.argsort(key, kind="stable")
        order[active], ordered = suffix[sort], key[sort]
        width *= 2


class WaveletMatrix:
    """Rank and access over symbols below ``2 ** levels``, for vectors of places."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        begin, end = np.zeros_like(place), place
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            set_ = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            begin = np.where(set_, zeros + ones[begin], begin - ones[begin])
            end = np.where(set_, zeros + ones[end], end - ones[end])
        return end - begin

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[place + 1] - ones[place]
            place = np.where(bit == 1, zeros + ones[place], place - ones[place])
            symbol = symbol * 2 + bit
        return symbol


class FMIndex:
    """Index of ``symbols``, all at least 1 and below ``size``."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = SAMPLE):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.wavelet = WaveletMatrix(text[order - 1], size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.n = len(text)
        sampled = order % sample == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long phrases, one a row.

        Returns the numbers of the phrases that occur and the suffix range of each.
        """
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[which, column]
            low = self.before[symbol] + self.wavelet.rank(symbol, low)
            high = self.before[symbol] + self.wavelet.rank(symbol, high)
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of suffix ranges: number of the range, start in the text."""
        owner = np.repeat(np.arange(len(low)), high - low)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        start = np.zeros(len(place), np.int64)
        open_ = np.arange(len(place))
        steps = 0
        while len(open_):
            at = place[open_]
            done = self.sampled[at]
            start[open_[done]] = self.samples[self.sample_rank[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            symbol = self.wavelet.access(at)
            place[open_] = self.before[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return owner, start
