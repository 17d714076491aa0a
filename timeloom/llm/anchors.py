"""Anchors: content-chosen tokens that own the fixed-length windows of a text.

Each window of `length` tokens is owned by the `gram`-token piece inside it whose Rabin-Karp hash is
least (leftmost on ties). Which piece that is depends on the window's content alone, so equal windows
have equal owners at equal offsets, wherever they stand. Windows with one owner are consecutive: a run.
The runs of a text partition its windows, and are a small part of them in number:

- a gram that owns one run in the corpus proves its windows unique;
- runs with the same content are equal window by window, so one row counts them all;
- only runs that share a gram but differ in content need their windows compared singly.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_POS_BITS = np.uint64(24)
_POS_MASK = np.uint64((1 << 24) - 1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        base = np.full(size, _BASE, np.uint64)
        inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _powers[:] = [np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)]
    return _powers[0], _powers[1]


def rolling_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2^64, then mixed) of each `length` consecutive codes."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(codes) + 1)
    h = np.empty(len(codes) + 1, np.uint64)
    h[0] = 0
    np.cumsum(codes.astype(np.uint64) * up[: len(codes)], out=h[1:])
    out = h[length:] - h[:n]
    out *= down[:n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n, span, cur = len(values) - width + 1, 1, values
    while span * 2 <= width:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    return np.minimum(cur[:n], cur[width - span : width - span + n])


def runs(codes: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """codes of several texts one after another (under 2^24 in all), ends: where each text ends.

    Returns arrays (text, lo, hi, at, hash): the windows that start at lo..hi of codes are owned by
    the gram at `at`, whose hash is `hash`; text: which text."""
    if len(codes) > int(_POS_MASK):
        raise ValueError("too many tokens at once")
    starts = np.concatenate(([0], ends[:-1]))
    empty = np.empty(0, np.int64)
    if len(codes) < length:
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    hashes = rolling_hashes(codes, gram)
    packed = (hashes & ~_POS_MASK) | np.arange(len(hashes), dtype=np.uint64)
    owner = (_sliding_min(packed, length - gram + 1) & _POS_MASK).astype(np.int64)
    inside = np.zeros(len(codes) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.maximum(starts, ends - length + 1), -1)
    where = np.flatnonzero(np.cumsum(inside[: len(owner)]) > 0)
    if not len(where):
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    own = owner[where]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    last = np.concatenate((first[1:], [len(where)])) - 1
    lo, hi, at = where[first], where[last], own[first]
    return np.searchsorted(ends, lo, side="right"), lo, hi, at, hashes[at]
