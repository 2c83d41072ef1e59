"""Words of whole texts as arrays: boundaries and hashes of all words of an Arrow batch at once."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z and all of a non-ASCII character.
_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[97:123] = _PLAIN[128:] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
_SPACED = np.ones(256, bool)
_SPACED[[32, 9, 10, 11, 12, 13]] = False
CLASSES = {"plain": _PLAIN, "spaced": _SPACED}

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE, name: str = "up") -> np.ndarray:
    """base ** 0 .. base ** (n - 1), mod 2 ** 64."""
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def bounds(data: np.ndarray, ends: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and how many words come before each text (one more entry than texts). Words never cross texts."""
    inside = CLASSES[kind][data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    first = np.zeros(len(data), bool)
    first[ends[:-1][ends[:-1] < len(data)]] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = np.zeros(len(data), bool)
    tails = ends[1:] - 1
    last[tails[tails >= 0]] = True
    stops = np.flatnonzero(inside & (~after | last)) + 1
    return starts, stops, np.searchsorted(starts, ends)


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums over stretches of the data."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # stretches bound the memory for long inputs
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + step)))
        a, b = int(starts[lo]), int(stops[hi - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * powers(b - a), out=sums[1:])
        s, e = starts[lo:hi] - a, stops[lo:hi] - a
        out[lo:hi] = mix((sums[e] - sums[s]) * powers(b - a + 1, _INVERSE, "down")[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def windows(h: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words inside one text, and the word at which each starts. firsts: words before each text."""
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix(out * _BASE + h[i : i + n]) if i == width - 1 else out * _BASE + h[i : i + n]
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    at = np.flatnonzero(text[:n] == text[width - 1 : width - 1 + n])
    return out[at], at


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then the same for the next."""
    if not len(starts):
        return np.zeros(0, np.int64)
    total = int(sizes.sum())
    out = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return out + np.arange(total)
