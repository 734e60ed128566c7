"""Words of a text as byte ranges and 64-bit hashes, in numpy.

A word is a run of bytes outside space, tab, newline, vertical tab, form feed
and carriage return (``[^\\x20\\x09-\\x0D]+``); ``bytes.split`` cuts at exactly
these. Words are normalised to one space between them, so that a range of words
is one slice of bytes. Hashes are polynomial over the bytes of a word (a table
of random 64-bit values per byte, prefix sums modulo 2^64), then mixed; windows
of words are hashed the same way over the word hashes.
"""

from __future__ import annotations

import numpy as np

#: Seed of the byte table and the odd bases of the two polynomials.
_SEED, _BYTE_BASE, _WORD_BASE = 20240611, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


class _Powers:
    """base^i and base^-i modulo 2^64, extended as longer texts come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if n > len(self.up):
            size = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(size, base & _MASK, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_TABLE = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normalised(text: str | None) -> bytes:
    """The words of a text, joined by one space, as UTF-8."""
    return b" ".join(text.encode("utf-8").split()) if text else b""


def word_ranges(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of a normalised text."""
    if not joined:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))


def word_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _BYTES.to(len(joined) + 1)
    sums = np.empty(len(joined) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[np.frombuffer(joined, np.uint8)] * up[: len(joined)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` consecutive words; fewer words: none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _WORDS.to(len(words) + 1)
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n] + np.uint64(size))


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + size, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
