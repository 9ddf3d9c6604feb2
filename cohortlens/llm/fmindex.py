"""FM-index over integer symbols: wavelet matrix of packed bits, backward search."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector of 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        count = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.concatenate([np.zeros(1, np.uint32), np.cumsum(count, dtype=np.uint32)[:-1]])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & below)


class Wavelet:
    """Wavelet matrix: one bit vector per bit of the symbols, the highest first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            one = (symbols >> b) & 1
            self.levels.append((b, Bits(one), int(len(one) - one.sum())))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before place ``at``, for each pair."""
        start = np.zeros(len(at), np.int64)
        for b, bits, zeros in self.levels:
            one = (symbol >> b) & 1 == 1
            lo, hi = bits.ones(start), bits.ones(at)
            start = np.where(one, zeros + lo, start - lo)
            at = np.where(one, zeros + hi, at - hi)
        return at - start


class FMIndex:
    """Index of a text whose last symbol is the only 0, from its suffix array."""

    def __init__(self, t: np.ndarray, sa: np.ndarray, symbols: int):
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=symbols))])
        self.wavelet = Wavelet(t[sa - 1].astype(np.int64), max(1, int(symbols - 1).bit_length()))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns lengthened on the left by a symbol each."""
        n = len(lo)
        r = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.before[symbol] + r[:n], self.before[symbol] + r[n:]
