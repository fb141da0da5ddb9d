"""An FM-index over the words of a training shard, in NumPy: suffix array, wavelet matrix, backward search, locating."""

from __future__ import annotations

import numpy as np

from .common import ship_by_value

ship_by_value(__name__)

#: Every so many words of a document, a suffix position is kept.
SAMPLE = 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of integers in which each document ends in a symbol of its own, so that no two suffixes tie for ever.

    The first sort packs as many symbols into 62 bits as fit; then the sorted prefix doubles, and only suffixes that
    still tie are sorted again.
    """
    n = len(s)
    bits = max(1, int(s.max()).bit_length())
    width = max(1, 62 // bits)
    padded = np.concatenate((s.astype(np.int64), np.zeros(width, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(width):
        key <<= bits
        key |= padded[j : j + n]
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    del padded, key, sorted_key
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    places = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(places):
        own = order[places]
        major, minor = rank[own], rank[own + width]
        by = np.argsort(major * n + minor)
        own, major, minor = own[by], major[by], minor[by]
        order[places] = own
        fresh = np.concatenate(([True], (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])))
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(own)))
        rank[own] = np.repeat(places[starts], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        width *= 2
    return order


class WaveletMatrix:
    """Ranks of a symbol before a place, for many (symbol, place) at once."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:], dtype=np.int32)
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            high = bit.astype(bool)
            seq = np.concatenate((seq[~high], seq[high]))
        symbols = np.arange(sigma)
        self.base = self._down(symbols, np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][place]
            place = np.where((symbol >> level) & 1, self.zeros[k] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._down(symbol, place) - self.base[symbol]

    def symbol_and_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank before that place."""
        symbol = np.zeros(len(place), np.int64)
        for k in range(self.levels):
            ones = self.ones[k][place]
            bit = self.ones[k][place + 1] - ones
            symbol = (symbol << 1) | bit
            place = np.where(bit, self.zeros[k] + ones, place - ones)
        return symbol, place - self.base[symbol]


class FMIndex:
    """Of documents given as one array of symbols: 0 ends a document, others are 1 to sigma - 1."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        ends = symbols == 0
        n_docs = int(ends.sum())
        own = symbols.astype(np.int64) + (n_docs - 1)
        own[ends] = np.arange(n_docs)
        sa = suffix_array(own)
        self.bwt = WaveletMatrix(symbols[sa - 1].astype(np.int32), sigma)  # before the first word stands the last end
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))[:sigma]
        starts = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
        lengths = np.diff(np.append(starts, len(symbols)))
        offset = np.arange(len(symbols)) - np.repeat(starts, lengths)
        kept = (offset % SAMPLE == 0)[sa]  # holds each document's first word, so no walk leaves its document
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.positions = sa[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of many phrases at once: ``phrases`` holds each, from the right, padded with 0."""
        total = len(self.kept_before) - 1
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), total, np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            live = live[(lengths[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            c = phrases[live, step]
            low[live] = self.before[c] + self.bwt.rank(c, low[live])
            high[live] = self.before[c] + self.bwt.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk to the word before until a row whose position was kept."""
        found = np.empty(len(rows), np.int64)
        at, walked, of = rows.copy(), 0, np.arange(len(rows))
        while len(of):
            seen = self.kept_before[at + 1] > self.kept_before[at]
            found[of[seen]] = self.positions[self.kept_before[at[seen]]] + walked
            at, of = at[~seen], of[~seen]
            symbol, rank = self.bwt.symbol_and_rank(at)
            at = self.before[symbol] + rank
            walked += 1
        return found
