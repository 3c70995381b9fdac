"""A minimal acyclic transducer from words to sequences of ids, in one block of bytes that can be memory-mapped.

Words that end alike share the states of their endings. An output stands as near the start as all words behind it allow
(what they have in common), so that equal endings stay equal. Words are added in order of bytes: only the states along
the last word can still change, all others are final and known by what they accept, so the automaton is minimal at all
times and takes memory for its own size, not for that of the trie.

Lookups walk many words at once: step t moves all words that are still inside by their byte t.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_PARTS = ["labels", "targets", "outputs", "finals", "bounds", "ids"]


class _State:
    """A state along the last word: its arcs, byte to [target, output], and what follows if a word ends in it."""

    __slots__ = ("arcs", "end")

    def __init__(self):
        self.arcs: dict[int, list] = {}
        self.end: tuple[int, ...] | None = None


def _in_common(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def compile_words(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The transducer of (word, ids) in strictly rising order of words."""
    known: dict[tuple, int] = {}
    refs: dict[tuple[int, ...], int] = {(): 0}
    path, last, longest = [_State()], None, 0

    def freeze(state: _State) -> int:
        arcs = tuple((byte, to, refs.setdefault(out, len(refs))) for byte, (to, out) in sorted(state.arcs.items()))
        return known.setdefault((-1 if state.end is None else refs.setdefault(state.end, len(refs)), arcs), len(known))

    def shorten(to: int) -> None:
        while len(path) > to + 1:
            done = path.pop()
            path[-1].arcs[last[len(path) - 1]][0] = freeze(done)

    for word, ids in entries:
        if last is not None and word <= last:
            raise ValueError("words must come in strictly rising order")
        shared = _in_common(tuple(word), tuple(last or b""))
        shorten(shared)
        left = tuple(ids)
        for k in range(shared):  # what the new word can't give moves one state on
            arc, state = path[k].arcs[word[k]], path[k + 1]
            n = _in_common(arc[1], left)
            if n < len(arc[1]):
                moved, arc[1] = arc[1][n:], arc[1][:n]
                for on in state.arcs.values():
                    on[1] = moved + on[1]
                if state.end is not None:
                    state.end = moved + state.end
            left = left[n:]
        for byte in word[shared:]:
            path[-1].arcs[byte] = [-1, left]
            left = ()
            path.append(_State())
        path[-1].end = left
        last, longest = word, max(longest, len(word))
    shorten(0)
    start = freeze(path[0])

    labels, targets, outputs, finals = [], [], [], []
    for state, (end, arcs) in enumerate(known):  # in the order of their numbers
        finals.append(end)
        for byte, to, out in arcs:
            labels.append(state << 8 | byte)
            targets.append(to)
            outputs.append(out)
    ids = [i for x in refs for i in x]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in refs])])
    parts = [np.array(x, np.int64) for x in (labels, targets, outputs, finals, bounds, ids)]
    return np.array([start, longest, *map(len, parts)], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)


class Transducer:
    def __init__(self, image):
        """image: the bytes of compile_words, or a memory map of a file that holds them."""
        head = np.frombuffer(image, np.int64, 2 + len(_PARTS))
        self.start, self.longest, at = int(head[0]), int(head[1]), 8 * len(head)
        for name, n in zip(_PARTS, head[2:].tolist(), strict=True):
            setattr(self, name, np.frombuffer(image, np.int64, n, at))
            at += 8 * n

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the words that it knows; the ids of these, one after the other; n + 1 bounds)."""
        lengths = np.array([len(w) for w in words], np.int64)
        row = np.flatnonzero(lengths <= self.longest)
        data = np.frombuffer(b"".join([words[i] for i in row]), np.uint8)
        lengths = lengths[row]
        first = np.cumsum(lengths) - lengths
        state = np.full(len(row), self.start)
        inside, t, said = np.arange(len(row)), 0, []
        arrived: list[np.ndarray] = []
        while len(inside):
            ended = inside[lengths[inside] == t]
            end = self.finals[state[ended]]
            arrived.append(ended[end >= 0])
            said.append((arrived[-1], end[end >= 0]))
            inside = inside[lengths[inside] > t]
            label = state[inside] << 8 | data[first[inside] + t]
            arc = np.searchsorted(self.labels, label)
            arc[arc == len(self.labels)] = 0
            on = self.labels[arc] == label if len(self.labels) else np.zeros(len(arc), bool)
            inside, arc = inside[on], arc[on]
            state[inside] = self.targets[arc]
            said.append((inside, self.outputs[arc]))
            t += 1
        found = np.sort(np.concatenate(arrived)) if arrived else np.zeros(0, np.int64)
        place = np.full(len(row), -1)
        place[found] = np.arange(len(found))
        who = np.concatenate([w for w, _ in said]) if said else np.zeros(0, np.int64)
        ref = np.concatenate([r for _, r in said]) if said else np.zeros(0, np.int64)
        who = place[who]
        real = (who >= 0) & (ref > 0)
        order = np.argsort(who[real], kind="stable")  # in the order of the steps, for each word
        who, ref = who[real][order], ref[real][order]
        n = self.bounds[ref + 1] - self.bounds[ref]
        ids = self.ids[np.repeat(self.bounds[ref] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        held = np.zeros(len(found), np.int64)
        np.add.at(held, who, n)
        return row[found], ids, np.concatenate([[0], np.cumsum(held)])
