"""Anchors of byte windows: every window of `match` bytes names one place inside it, chosen by content alone."""

from __future__ import annotations

import numpy as np

from .common import U64, byte_codes, mix, window_hashes

ANCHOR = 64
#: Bytes that each term of a fingerprint joins. Single bytes as terms cancel in texts like the Thue-Morse sequence, whose halves
#: differ in sign alone; strings of eight that lie across a border don't.
TERM = 8
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=U64)
    return _POWERS


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Of each window of `width` values the place of its least; of equals the first. Blocks of prefix and suffix minima."""
    n = len(values) - width + 1
    bits = max(1, int(len(values)).bit_length())
    packed = (values >> U64(bits)) << U64(bits) | np.arange(len(values), dtype=U64)
    full = -len(packed) % width
    padded = np.concatenate([packed, np.full(full, U64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[:n], head[width - 1 : width - 1 + n])
    return (least & U64((1 << bits) - 1)).astype(np.int64)


class Windows:
    """Hashes over the concatenated bytes of several texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, match: int):
        self.data, self.offsets, self.match = data, offsets, match
        codes = byte_codes(data)
        self.up, self.down = _powers(len(data) + 1)
        terms = mix(window_hashes(codes, [TERM])[TERM])
        self.sums = np.zeros(len(terms) + 1, U64)
        np.cumsum(terms * self.up[: len(terms)], dtype=U64, out=self.sums[1:])
        self._codes, self._places = codes, None

    @property
    def places(self) -> np.ndarray:
        """The hash of the anchor's width at each place."""
        if self._places is None:
            self._places = window_hashes(self._codes, [ANCHOR])[ANCHOR] if len(self.data) >= ANCHOR else np.zeros(0, U64)
            self._codes = None
        return self._places

    def hash(self, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
        """64-bit hashes of data[starts:ends], of TERM bytes or more, apart for each kind."""
        return mix((self.sums[ends - (TERM - 1)] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64) * U64(0xD1342543DE82EF95) + U64(kind))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, anchor, first and last window start) of each run of windows of one text that share an anchor."""
        m, n = self.match, len(self.data)
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none, none, none
        anchor = sliding_argmin(self.places, m - ANCHOR + 1)
        starts = np.arange(n - m + 1)
        text = np.searchsorted(self.offsets, starts, "right") - 1
        inside = starts + m <= self.offsets[text + 1]
        starts, text, anchor = starts[inside], text[inside], anchor[inside]
        if not len(starts):
            return none, none, none, none
        first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        at = np.flatnonzero(first)
        last = np.concatenate([at[1:], [len(starts)]]) - 1
        return text[at], anchor[at], starts[at], starts[last]
