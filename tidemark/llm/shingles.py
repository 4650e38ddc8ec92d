"""Word-shingle sets of whole texts as sorted arrays of 64-bit hashes, vectorised over many texts."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: A second hash for where 64 bits don't suffice.
_BYTE2 = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BASES = (_BASE, _INVERSE, _BASE2, np.uint64(pow(int(_BASE2), -1, 2**64)))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 4


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs only give equal outputs."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers(n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse."""
    at = 2 * second
    if len(_POWERS[at]) < n:
        size = max(n, 1 << 18)
        for k in (at, at + 1):
            p = np.full(size, _BASES[k], np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[at][:n], _POWERS[at + 1][:n]


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``size``-word shingles.

    A-Z are lower-cased; words are runs of characters other than blank and
    U+0009 to U+000D.  A text with fewer words is one shingle, one without words
    has none.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    none = np.zeros(0, np.uint64)
    if not len(data):
        return [none] * len(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    words = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[0])
    borders = np.cumsum([len(r) + 1 for r in raw])
    per_text = np.searchsorted(starts, borders)  # words that start before each text's end
    grams = words.copy()
    for k in range(1, size):
        grams = grams[: len(words) - k] if len(words) > k else grams[:0]
        grams = mix(grams * _MIX[1] + words[k : k + len(grams)])
    out, at = [], 0
    for end in per_text.tolist():
        n = end - at
        if n >= size:
            h = np.sort(grams[at : end - size + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif n:
            h = words[at : at + 1]
            for k in range(1, n):
                h = mix(h * _MIX[1] + words[at + k : at + k + 1])
            out.append(mix(h + np.uint64(n)))
        else:
            out.append(none)
        at = end
    return out
