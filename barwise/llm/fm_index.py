"""FM-index over word ids, in numpy: suffix order, wavelet matrix, backward
search of many patterns at once, locate by sampled suffix positions.

Symbol 0 separates runs. Each separator is a symbol of its own to the suffix
order, so comparisons end at the run; patterns never hold one.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` in order, by prefix doubling."""
    n = len(s)
    zeros = s == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, s + zeros.sum()).astype(np.uint64)
    edges = np.flatnonzero(np.append(zeros, True))
    longest = int(np.diff(edges, prepend=-1).max())
    h = 1
    while True:
        later = np.zeros(n, np.uint64)
        later[:n - h] = rank[h:] + np.uint64(1)
        key = rank << np.uint64(32) | later
        sa = np.argsort(key, kind="stable")
        k = key[sa]
        new = np.append(True, k[1:] != k[:-1])
        rank = np.empty(n, np.uint64)
        rank[sa] = np.cumsum(new) - 1
        h *= 2
        if h > longest or new.all():
            return sa


class _Bits:
    """Bit vector with rank by word counts and popcount."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, s: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels = []
        for b in range(self.depth - 1, -1, -1):
            bit = (s >> b) & 1
            self.levels.append((b, _Bits(bit), int(len(s) - bit.sum())))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.first = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> b) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[k] before position i[k]."""
        return self._walk(c, i) - self.first[c]

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for b, bits, zeros in self.levels:
            bit, ones = bits.get(i).astype(np.int64), bits.rank(i)
            c |= bit << b
            i = np.where(bit, zeros + ones, i - ones)
        return c


class FMIndex:
    def __init__(self, s: np.ndarray, sigma: int):
        s = s.astype(np.int64)
        sa = suffix_array(s)
        before = s[sa - 1]
        self.wavelet = WaveletMatrix(before, sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        # sampled: every SAMPLE-th position and the first of each run, so a walk never leaves its run
        self.sampled = _Bits((sa % SAMPLE == 0) | (before == 0) | (s[sa] == 0))
        self.samples = sa[(sa % SAMPLE == 0) | (before == 0) | (s[sa] == 0)]
        self.n = len(s)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the patterns (rows, aligned to the left)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            c = patterns[live, lengths[live] - back]
            lo[live] = self.less[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.less[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(self.sampled.get(rows) == 0)
        while len(open_):
            r = rows[open_]
            c = self.wavelet.access(r)
            rows[open_] = self.less[c] + self.wavelet.rank(c, r)
            steps[open_] += 1
            open_ = open_[self.sampled.get(rows[open_]) == 0]
        return self.samples[self.sampled.rank(rows)] + steps
