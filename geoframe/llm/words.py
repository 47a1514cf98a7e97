"""Vectorised word splitting and hashing over raw UTF-8 bytes.

A word is a run of bytes outside 0x20 and 0x09-0x0D; A-Z are folded to a-z by
giving both cases the same hash value.  Hashes are 64-bit multilinear sums, so
no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 18
SHINGLE = 5


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply, after the splitmix generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _random64(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _random64(256, 11)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[SPACE] = 0
_PLACE = _random64(1 << 12, 23) | np.uint64(1)
_STEP = _random64(SHINGLE, 37) | np.uint64(1)
_COUNT = _random64(SHINGLE, 41)


def _place(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = _random64(1 << int(n - 1).bit_length(), 23) | np.uint64(1)
    return _PLACE


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SEGMENT that cut no word."""
    at, end = 0, len(data)
    while at < end:
        to = min(end, at + SEGMENT)
        while to < end and not (SPACE[data[to]] or SPACE[data[to - 1]]):
            near = offsets[np.searchsorted(offsets, to)]
            if near == to:
                break
            gap = np.flatnonzero(SPACE[data[to : to + 4096]])
            to = int(min(near, to + gap[0] if len(gap) else min(end, to + 4096)))
        yield at, to
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row index of each word, in order."""
    hashes, rows = [], []
    for a, b in _segments(data, offsets):
        part = data[a:b]
        word = ~SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = offsets[(offsets >= a) & (offsets < b)] - a
        first[inner] = word[inner]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        spans = np.diff(np.append(starts, len(part)))
        place = _place(int(spans.max()))
        head = int(starts[0])
        pos = np.arange(len(part) - head, dtype=np.int64)
        pos -= np.repeat(starts - head, spans)
        value = _BYTE[part[head:]] * place[pos]
        hashes.append(mix64(np.add.reduceat(value, starts - head)))
        rows.append(np.searchsorted(offsets, starts + a, side="right") - 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its 5-word shingles; a row of one to
    four words has its whole sequence as one shingle, a row without words has none."""
    hashes, rows = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    at = np.concatenate([[0], np.cumsum(counts)])
    size = len(hashes) - SHINGLE + 1
    if size > 0:
        rolled = hashes[:size] * _STEP[0]
        for j in range(1, SHINGLE):
            rolled += hashes[j : j + size] * _STEP[j]
        rolled = mix64(rolled)
    out = []
    for i in range(n):
        a, c = at[i], counts[i]
        if c >= SHINGLE:
            out.append(np.unique(rolled[a : a + c - SHINGLE + 1]))
        elif c:
            short = (hashes[a : a + c] * _STEP[:c]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(short + _COUNT[c : c + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set, as signed integers; 0 for an empty set."""
    n = len(sets)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        for out, key in ((one, 0x8CB92BA72F3D8DD7), (two, 0xC2B2AE3D27D4EB4F)):
            total = np.add.reduceat(mix64(flat ^ np.uint64(key)), starts)
            out[full] = mix64(total + size[full].astype(np.uint64) * np.uint64(key))
    return one.view(np.int64), two.view(np.int64)
