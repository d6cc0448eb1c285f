"""Words, word hashes and word windows of a batch of texts, in numpy.

Words are runs of bytes other than space and \\x09-\\x0D.  A word's hash is a
polynomial of its bytes modulo 2^64, taken from prefix sums and then mixed;
windows of words are hashed the same way over word hashes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
# Odd multipliers (invertible modulo 2^64) and the constants of the usual 64-bit finaliser: fixed values.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the information of each hash over all of its bits."""
    h = (h ^ (h >> U(30))) * U(MIX[0])
    h = (h ^ (h >> U(27))) * U(MIX[1])
    return h ^ (h >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base^i, base^-i) modulo 2^64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 1 << 21:  # longer ones are made anew, so that they don't stay in memory
            _powers[base] = have
    return have


def spaces(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of every word and the first word of every document, one more than documents."""
    inside = ~spaces(raw)
    first = np.zeros(len(raw) + 1, bool)
    first[ends[:-1]] = True
    start = np.flatnonzero(inside & np.r_[True, ~inside[:-1]] | inside & first[:-1]) if len(raw) else np.empty(0, np.int64)
    last = np.flatnonzero(inside & (np.r_[~inside[1:], True] | first[1:])) + 1 if len(raw) else start
    return start, last, np.searchsorted(start, ends)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0)).astype(np.uint8)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    up, down = powers(BASES[which], len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def word_digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 of every word: slower than ``word_hashes``, but no family of long words shares one."""
    from xxhash import xxh64_intdigest

    found = map(raw.tobytes().__getitem__, map(slice, start.tolist(), end.tolist()))
    return np.fromiter(map(xxh64_intdigest, found), U, len(start))


def window_hashes(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every window of k words, over document borders too."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    up, down = powers(WINDOW_BASES[which], len(h))
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n])


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """For every window of k words: does it lie in one document?"""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.empty(0, bool)
    doc_end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= doc_end
