"""Hashes of words and word windows, vectorised over the bytes of many texts.

A word's hash is the polynomial sum of its (scrambled) bytes over a fixed odd base modulo 2^64, taken from prefix sums; windows
are hashed likewise from the words' hashes. All are 64 bits and mixed at the end, alike on every machine.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(range(256)).lower()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SCRAMBLED = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n at least."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def _prefix(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(len(x))[0][: len(x)], dtype=np.uint64, out=out[1:])
    return out


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of raw."""
    a = np.frombuffer(raw, np.uint8)
    blank = np.empty(len(a) + 2, bool)
    blank[0] = blank[-1] = True
    blank[1:-1] = BLANKS[a]
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = turn[::2], turn[1::2]
    sums = _prefix(_SCRAMBLED[a])
    h = (sums[end] - sums[start]) * powers(len(a) + 1)[1][start]
    return start, mix(h + (end - start).astype(np.uint64) * np.uint64(BASE))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the hashes of the words of text i are hashes[offsets[i]:offsets[i + 1]]."""
    raw = b"\n".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, int)
    starts, hashes, at = [], [], 0
    while at < len(raw):
        upto = min(len(raw), at + PIECE)
        while upto < len(raw) and not BLANKS[raw[upto]]:
            upto += 1
        s, h = _hash_piece(raw[at:upto])
        starts.append(s + at)
        hashes.append(h)
        at = upto
    start = np.concatenate(starts) if starts else np.zeros(0, int)
    return np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64), np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes from each place on that has so many."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = []
    for a in range(0, n, PIECE):
        part = hashes[a : a + PIECE + k - 1]
        sums, m = _prefix(part), len(part) - k + 1
        out.append(mix((sums[k:] - sums[:-k]) * powers(m)[1][:m] + np.uint64(k)))
    return np.concatenate(out)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of the k values from each place on that has so many."""
    n, span = len(x) - k + 1, 1
    if n <= 0:
        return x[:0]
    while span * 2 <= k:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[k - span : k - span + n])


def inside(offsets: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of k words over n words of many texts: whether each lies in one text, and the text it starts in."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: max(0, n - k + 1)]
    at = np.arange(len(owner))
    return at + k <= offsets[owner + 1], owner
