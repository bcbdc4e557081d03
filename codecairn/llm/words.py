"""Words, shingles and their hashes for many texts at once, on numpy arrays.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. Texts are UTF-8 bytes; no byte of a longer
character is white space, so words are found on bytes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_WORD = bytes(0 if i in SPACES else 1 for i in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def blocks(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` bytes; one longer text is a range of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.zeros(len(text) + 2, np.uint8)
    inside[1:-1] = np.frombuffer(text.translate(_IS_WORD), np.uint8)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit hash per word of all texts, in order; the words of text i are ``[at[i], at[i + 1])``.

    A hash covers the length and the bytes of its word in blocks of eight.
    """
    joined = b"\n".join(texts)
    starts, ends = word_bounds(joined)
    at = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    padded = np.frombuffer(joined + bytes(15), np.uint8)
    eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(joined) + 8,), (1,))
    left = ends - starts
    h = mix(mix(left) ^ eights[starts] & _MASKS[np.minimum(left, 8)])
    alive = np.flatnonzero(left > 8)
    done = 8
    while len(alive):
        rest = left[alive] - done
        h[alive] = mix(h[alive] * _BASE ^ eights[starts[alive] + done] & _MASKS[np.minimum(rest, 8)])
        alive = alive[rest > 8]
        done += 8
    return h, at


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash per window of ``size`` consecutive words; empty with fewer words."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h *= _BASE
        h += words[k:k + n]
    return mix(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values without repeats."""
    s = np.sort(values)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
