"""A compressed FM-index on whole NumPy arrays: the Burrows-Wheeler transform in a wavelet tree, searched backwards.

The tree is kept level by level (a wavelet matrix): one packed bit vector a level of the symbols' binary codes, with
running counts every 64 bits. Searches run for all patterns at once; each takes two rank queries a level and symbol.
"""

from __future__ import annotations

import numpy as np

from weftline.llm.arrays import U64
from weftline.llm.suffix_array import double_ranks


class BitVector:
    """Bits with constant-time rank: 64 bits a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        packed = np.packbits(np.concatenate((bits.astype(np.uint8), np.zeros(-len(bits) % 64 + 64, np.uint8))), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)
        self.zeros = self.n - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Symbols 0 .. kinds - 1 with rank by symbol."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.levels: list[BitVector] = []
        self.depth = max(int(kinds - 1).bit_length(), 1)
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.levels.append(BitVector(bits))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        self.start = self._descend(np.arange(kinds), np.zeros(kinds, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels):
            ones = bits.ones(at)
            at = np.where((symbol >> level) & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbol, at) - self.start[symbol]


class FMIndex:
    """Index of a sequence of symbols 0 .. kinds - 1 that ends with a unique 0. Patterns up to `longest` symbols.

    Suffixes are sorted by their first symbols, longest + 1 of them at least, which is all that patterns of that length
    can tell apart. Their order is let go of once the transform is made: the index is the tree's bits (one a symbol and level,
    and a count every 64) and a number a kind of symbol.
    """

    def __init__(self, symbols: np.ndarray, kinds: int, longest: int) -> None:
        suffixes = double_ranks(symbols, longest + 1)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=kinds))))
        self.tree = WaveletMatrix(symbols[suffixes - 1], kinds)
        self.n = len(symbols)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from the patterns' intervals [lo, hi)."""
        both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi))) + np.concatenate((self.first[symbol],) * 2)
        return both[: len(symbol)], both[len(symbol) :]

    def matches(self, stream: np.ndarray, starts: np.ndarray, length: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a stream, above a threshold: for the windows of `length` symbols at starts that occur
        `least` times or more, their numbers and intervals [lo, hi) in the order of suffixes. A search ends as soon as its
        interval is too small."""
        who = np.arange(len(starts))
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        for j in range(length - 1, -1, -1):
            lo, hi = self.step(stream[starts[who] + j], lo, hi)
            go = hi - lo >= least
            who, lo, hi = who[go], lo[go], hi[go]
        return who, lo, hi
