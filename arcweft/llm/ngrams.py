"""Vectorised hashing of the words and letters of many texts at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and an odd multiplier with its inverse modulo 2**64.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z to a-z, other ASCII that is no letter to a blank; bytes of other scripts stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, n - 1), base, np.uint64))])[:n]


_cache: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _cache.get("n", 0) < n:
        size = 1 << max(16, n.bit_length())
        _cache.update(n=size, up=_powers(_BASE, size), down=_powers(_INVERSE, size))
    return _cache["up"], _cache["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def folded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, letters folded, a blank behind each; and where each starts (and the last ends)."""
    data = _FOLD[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return data, starts


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of letters), and the text that each is in."""
    data, starts = folded(texts)
    letter = data != 32
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    return mix((total[last] - total[first]) * down[first]), np.searchsorted(starts, first, side="right") - 1


def letter_grams(texts: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (below ``dim``) of the byte 2-, 3- and 4-grams that start at each byte, -1 where there is none.

    Runs of blanks count as one.  Returns (grams x bytes) buckets and where each text starts.
    """
    data, starts = folded(texts)
    keep = (data != 32) | np.concatenate([[True], data[:-1] != 32])
    keep[starts[1:] - 1] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    data, starts = data[keep], kept[starts]
    code = np.zeros(len(data) + 4, np.uint64)
    out = np.full((3, len(data)), -1, np.int32)
    code[: len(data)] = data
    h = code[:-4].copy()
    text_end = np.repeat(starts[1:], np.diff(starts))
    here = np.arange(len(data))
    for n in (2, 3, 4):
        h = h * np.uint64(257) + code[n - 1 : n - 1 + len(data)]
        bucket = ((h * np.uint64(n) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % dim
        out[n - 2] = np.where(here + n <= text_end, bucket, -1)
    return out, starts
