"""Whole Arrow batches of text as flat numpy code-point arrays: words, word n-grams and hashes.

Everything here works on a batch at once; no Python code runs per character or per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def word_char_table() -> np.ndarray:
    """Flag for each code point: letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """The code of each code point's (first) lower-case character."""
    return np.fromiter((ord(chr(i).lower()[0]) for i in range(0x110000)), np.uint32, 0x110000)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); wraps modulo 2**64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal True runs."""
    step = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every word (maximal run of letters and digits, lower-cased), in order."""
    low = [t.lower() for t in texts]
    codes = codes_of("\n".join(low) + "\n")
    alnum = word_char_table()[codes]
    starts, ends = runs(alnum)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    limits = np.cumsum(np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low)))
    of = np.repeat(np.arange(len(low)), np.diff(np.searchsorted(starts, limits), prepend=0))
    return run_hashes(codes, starts, ends), of


_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64, kept for the next batch."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS


@lru_cache(maxsize=1)
def _scatter_table() -> np.ndarray:
    return mix((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * _GOLD)


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each (non-empty) run of codes: its part of one running polynomial sum, shifted to the run's start."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_scatter_table()[codes] * power[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def ngram_hashes(word: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of ``n`` consecutive words of one text."""
    count = len(word) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = mix(word[:count] * np.uint64(3) + np.uint64(1))
    for j in range(1, n):
        x = mix(x + mix(word[j : count + j] + np.uint64(j)))
    inside = of[:count] == of[n - 1 :]
    return x[inside], of[:count][inside]


def distinct_per_text(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, each value once per text, ordered by text and value."""
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
    return x[keep], of[keep]
