"""Word shingles of texts as 64-bit hashes, vectorised over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from .common import U64, _join, mix

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What is kept of eight bytes of which the first so many belong to the word.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of finalised eights of bytes, each eight finalised with its own place; no polynomial, whose powers of two cancel in texts
    like the Thue-Morse sequence."""
    if not len(starts):
        return np.zeros(0, U64)
    sizes = ends - starts
    eights = sizes + 7 >> 3
    first = np.cumsum(eights) - eights
    within = np.arange(eights.sum()) - np.repeat(first, eights)
    at = np.repeat(starts, eights) + 8 * within
    code = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(7, np.uint8)]), 8)[at].view(U64).ravel()
    code &= _MASKS[np.minimum(np.repeat(ends, eights) - at, 8)]
    salted = mix(code + mix((within + 1).astype(U64) * U64(0x9E3779B97F4A7C15)))
    return mix(np.add.reduceat(salted, first) + sizes.astype(U64) * U64(0xD1342543DE82EF95))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, text index) of all words of texts data[offsets[i]:offsets[i + 1]]."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), none
    solid = ~_BLANK[data]
    begin, last = solid.copy(), solid.copy()
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[1:] &= ~solid[:-1]
    begin[inner] = solid[inner]
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    hashes = _word_hashes(_LOWER[data] if lower else data, starts, ends)
    return starts, ends, hashes, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its shingles; a text of fewer words is one shingle, one without words none."""
    _, _, hashes, text = words(data, offsets)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    joined, short = hashes, np.diff(bounds)
    for k in range(1, width):
        joined = _join(joined[:-1], hashes[k:]) if len(joined) > 1 else np.zeros(0, U64)
    out = []
    for i in range(len(offsets) - 1):
        a, b = bounds[i], bounds[i + 1]
        if short[i] >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif short[i]:
            whole = hashes[a : a + 1]
            for k in range(a + 1, b):
                whole = _join(whole, hashes[k : k + 1])
            out.append(mix(whole + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out
