"""Vectorised words of a block of texts: 64-bit word codes and fingerprints of word sequences."""

from __future__ import annotations

import numpy as np

from churnforge.llm.textbatch import mix64

#: Bytes whose words are coded together.
CHUNK = 1 << 20
BYTE_STEP, WORD_STEP = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15     # odd multipliers
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int, held: dict = {}) -> np.ndarray:  # noqa: B006  kept for the worker's life, CHUNK entries at most
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(held.get(base, ())) < n:
        steps = np.full(max(n, CHUNK), base, np.uint64)
        steps[0] = 1
        full = np.cumprod(steps)
        if n > CHUNK:
            return full
        held[base] = full
    return held[base][:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of each word, and the texts' offsets in words."""
    solid = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word's bytes."""
    codes = np.empty(len(starts), np.uint64)
    inverse = pow(BYTE_STEP, -1, 1 << 64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, side="right")))
        low, high = starts[a], ends[b - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data[low:high]] * _powers(BYTE_STEP, high - low), out=sums[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        codes[a:b] = (sums[e] - sums[s]) * _powers(inverse, high - low)[s] + (e - s).astype(np.uint64)
        a = b
    return mix64(codes)


class Sequences:
    """Fingerprints of the word sequences that start at any word: prefix sums of codes times powers."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _powers(WORD_STEP, len(codes)), out=self.sums[1:])
        self.inverse = _powers(pow(WORD_STEP, -1, 1 << 64), max(1, len(codes)))

    def fingerprint(self, at: np.ndarray, words: int, salt: int = 0) -> np.ndarray:
        """Of `words` words from each place in `at`; different salts give independent-looking values."""
        return mix64((self.sums[at + words] - self.sums[at]) * self.inverse[at] + np.uint64(salt * WORD_STEP & 0xFFFFFFFFFFFFFFFF))
