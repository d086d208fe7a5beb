"""Words of texts as 64-bit hashes, by numpy over whole batches."""
from __future__ import annotations

import numpy as np

from holdfast.llm.text import mix

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: A random-looking word for each byte value.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2 ** 64."""
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.empty(size, np.uint64)
            p[0], have = 1, 1
            while have < size:
                p[have:2 * have] = p[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            _POWERS[name] = p
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of byte words times base ** position, modulo 2 ** 64."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:len(raw)], out=out[1:])
    return out


def words(raw: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and offsets of the words of each text. Words don't cross texts."""
    if lower:
        raw = _LOWER[raw]
    is_word = _IS_WORD[raw]
    first, last = is_word.copy(), is_word.copy()
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    if len(raw):
        same = np.ones(len(raw) - 1, bool)
        same[edge - 1] = False
        first[1:] &= ~(is_word[:-1] & same)
        last[:-1] &= ~(is_word[1:] & same)
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = prefix_hash(raw)
    _, down = powers(len(raw) + 1)
    return mix((h[end] - h[start]) * down[start]), start, end, np.searchsorted(start, off)


def shingles(hashes: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, and their offsets. A text of fewer words is one shingle."""
    mult = np.uint64(0xA0761D6478BD642F)
    n = np.diff(woff)
    total = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        total = total * mult + hashes[i:i + len(total)]
    total = mix(total)
    parts, size = [], np.zeros(len(n), np.int64)
    empty = np.zeros(0, np.uint64)
    for d, (a, b) in enumerate(zip(woff[:-1].tolist(), woff[1:].tolist())):
        if b - a >= k:
            s = np.sort(total[a:b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            whole = b - a  # its length tells it from longer ones
            for w in hashes[a:b].tolist():
                whole = (whole * int(mult) + w) & 0xFFFFFFFFFFFFFFFF
            s = mix(np.array([whole ^ 0x5555], np.uint64))
        else:
            s = empty
        parts.append(s)
        size[d] = len(s)
    return (np.concatenate(parts) if parts else empty), np.concatenate([[0], np.cumsum(size)])
