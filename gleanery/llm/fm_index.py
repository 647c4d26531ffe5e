"""A full-text index of a sequence of symbols: Burrows-Wheeler transform, wavelet matrix, sampled positions.

Everything works on whole arrays: many patterns take a backward step together, and
many rows walk to their next sampled position together.
"""

from __future__ import annotations

import numpy as np

#: Every so many places of the sequence keep their position.
SAMPLE = 8
#: Rows that are located at once.
AT_ONCE = 1 << 20


def suffix_order(seq: np.ndarray, symbols: int) -> np.ndarray:
    """The places of seq in the order of their suffixes; its last symbol must be 0 and stand nowhere else.

    Suffixes are sorted by as many symbols as fit 63 bits, then those that are still
    tied by twice as many each time.
    """
    n, bits = len(seq), max(1, int(symbols - 1).bit_length())
    width = max(1, 63 // bits)
    padded = np.concatenate([seq, np.zeros(width, seq.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = key << np.uint64(bits) | padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rows = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(rows):
        place = order[rows]
        # tied suffixes agree on width symbols, so the last one isn't among these
        key = rank[place] << 32 | rank[place + width]
        by = np.argsort(key)
        place, key = place[by], key[by]
        first = np.ones(len(rows), bool)
        first[1:] = key[1:] != key[:-1]
        order[rows], new[rows] = place, first
        rank[place] = np.maximum.accumulate(np.where(first, rows, 0))
        rows = rows[~(first & np.append(first[1:], True))]
        width *= 2
    return order


class Bits:
    """A bit vector with the number of ones before every place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << inside) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """Ranks of symbols: a bit vector per bit of a symbol, zeros of a level before its ones on the next."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for level in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bit = (seq >> level & 1).astype(bool)
            low = seq[~bit]
            self.levels.append((level, Bits(bit), len(low)))
            seq = np.concatenate([low, seq[bit]])
        # equal symbols now stand together
        self.start = np.zeros(symbols, np.int64)
        first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        self.start[seq[first]] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start = self.start[symbol]
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        for level, bits, zeros in self.levels:
            bit, ones = bits.get(at), bits.rank(at)
            symbol |= bit.astype(np.int64) << level
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at - self.start[symbol]


class FMIndex:
    """seq: symbols from 1 to symbols - 1; 0 is the end's own."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        seq = np.append(seq, 0).astype(np.int32)
        order = suffix_order(seq, symbols)
        self.n = len(seq)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))]).astype(np.int64)
        self.wavelet = Wavelet(seq[order - 1], symbols)
        sampled = order % SAMPLE == 0
        self.sampled, self.places = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows (from, to) that begin with each pattern; a row of patterns ends at its size."""
        low, high = np.zeros(len(sizes), np.int64), np.where(sizes > 0, self.n, 0)
        for step in range(int(sizes.max(initial=0))):
            live = np.flatnonzero((sizes > step) & (high > low))
            if not len(live):
                break
            symbol = patterns[live, sizes[live] - 1 - step].astype(np.int64)
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.first[symbol] + both[: len(live)], self.first[symbol] + both[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each row's suffix: steps back to a sampled one are added to its position."""
        out, rows = np.empty(len(rows), np.int64), rows.copy()
        live = np.arange(len(rows))
        for step in range(SAMPLE):
            known = self.sampled.get(rows[live])
            found = live[known]
            out[found] = self.places[self.sampled.rank(rows[found])] + step
            live = live[~known]
            if not len(live):
                break
            symbol, before = self.wavelet.access(rows[live])
            rows[live] = self.first[symbol] + before
        return out
