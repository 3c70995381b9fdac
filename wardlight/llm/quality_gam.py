"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a look-up table over its bins, each chosen pair of features one over its bins' grid. The tables are
learned by cyclic boosting: round after round, feature by feature, a shallow tree of the current residuals is fitted
on the binned feature and added, shrunken, to its table; then the same for pairs, which are chosen by how much of the
residual a coarse grid explains. A text's score is the logistic function of the summed table entries.

Features are computed by one narrow, vectorised pass over whole texts. The model is fitted on a bounded sample of
labelled rows (labelled.MOST_LABELLED): a matrix of some 20 numbers a row.

Rows: a document that is labelled twice counts twice, also with either label. Null and empty texts have all features 0 and get the score of such a text. Null ids count as fold 0. Without
usable labels of both kinds the score is the one label's share (1 if there is none). Repeated rows are scored alike;
an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _join, crc_fold, steps, text_bytes, tidied
from .labelled import MOST_LABELLED, labelled_sample, sigmoid
from .word_shingles import words

FEATURES = [
    "log_words", "word_length", "upper", "digit", "stop", "mark", "other_punct", "bar", "bang", "beyond_ascii", "line_length",
    "distinct_words", "distinct_pairs", "repeated_next", "marked_words", "longest_word", "distinct_lines", "vowel", "short_words", "log_lines",
]


def _classes() -> np.ndarray:
    of = np.zeros(256, np.uint8)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"#*$%&<>", b"\"'()[]{}=+-_/\\@^~`", b"|", b"!", b"aeiou", b"\n"), 1):
        of[list(chars)] = k
    of[192:] = 10  # a first byte beyond ASCII
    return of


_CLASS = _classes()


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES a text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    starts, ends, hashes, text = words(data, offsets)
    classes = _CLASS[data]
    place = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(place * 11 + classes, minlength=11 * n).reshape(n, 11).astype(float)
    length = ends - starts
    n_words = np.bincount(text, minlength=n).astype(float)
    chars = np.maximum(np.bincount(text, length, n), 1.0)
    some = np.maximum(n_words, 1.0)
    share = counts / chars[:, None]
    col = {name: i for i, name in enumerate(FEATURES)}
    out[:, col["log_words"]] = np.log1p(n_words)
    out[:, col["word_length"]] = np.where(n_words > 0, chars / some, 0)
    for name, k in (("upper", 1), ("digit", 2), ("stop", 3), ("mark", 4), ("other_punct", 5), ("bar", 6), ("bang", 7), ("vowel", 8), ("beyond_ascii", 10)):
        out[:, col[name]] = share[:, k]
    lines = counts[:, 9] + 1
    out[:, col["log_lines"]] = np.log(lines)
    out[:, col["line_length"]] = np.log1p(n_words / lines)
    if len(starts):
        mark = np.isin(classes[ends - 1], (4, 7))
        out[:, col["marked_words"]] = np.bincount(text, mark, n) / some
        out[:, col["short_words"]] = np.bincount(text, length <= 3, n) / some
        longest = np.zeros(n)
        np.maximum.at(longest, text, length)
        out[:, col["longest_word"]] = np.log1p(longest)
        out[:, col["distinct_words"]] = _distinct(text, hashes, n) / some
        inside = text[1:] == text[:-1]
        pair_text = text[:-1][inside]
        out[:, col["distinct_pairs"]] = _distinct(pair_text, _join(hashes[:-1], hashes[1:])[inside], n) / np.maximum(n_words - 1, 1)
        out[:, col["repeated_next"]] = np.bincount(pair_text, (hashes[1:] == hashes[:-1])[inside], n) / some
        # A line is known by the sum of its words' hashes, weighted by their order.
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        line = breaks[starts] + text  # text borders part lines as well
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        order = (np.arange(len(starts)) - np.repeat(first, np.diff(np.concatenate([first, [len(starts)]])))).astype(U64)
        sums = np.add.reduceat(_join(hashes, order), first)
        full = np.maximum(np.bincount(text[first], minlength=n), 1)
        out[:, col["distinct_lines"]] = _distinct(text[first], sums, n) / full
    return out


def _distinct(text: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each text has."""
    found = np.zeros(n)
    bounds = np.searchsorted(text, np.arange(n + 1))
    for i in np.flatnonzero(np.diff(bounds)):
        own = np.sort(keys[bounds[i] : bounds[i + 1]])
        found[i] = 1 + np.count_nonzero(own[1:] != own[:-1])
    return found


class AdditiveModel:
    """Tables over bins. bins: inner edges of each feature; pairs: feature numbers of each grid."""

    def __init__(self, bins: int = 32, grid: int = 8, pairs: int = 8, rounds: int = 300, pair_rounds: int = 120, rate: float = 0.1, least: float = 2.0):
        self.n_bins, self.grid, self.n_pairs, self.rounds, self.pair_rounds, self.rate, self.least = bins, grid, pairs, rounds, pair_rounds, rate, least

    @staticmethod
    def _edges(x: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1], method="lower"))

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        k = x.shape[1]
        self.edges = [self._edges(x[:, j], self.n_bins) for j in range(k)]
        self.coarse = [self._edges(x[:, j], self.grid) for j in range(k)]
        binned = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]
        rough = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.coarse)]
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j in range(k):
                p = sigmoid(raw)
                step = self.rate * self._tree(np.bincount(binned[j], y - p, len(self.tables[j])), np.bincount(binned[j], p * (1 - p), len(self.tables[j])))
                self.tables[j] += step
                raw += step[binned[j]]
        gains = []
        p = sigmoid(raw)
        for a in range(k):
            for b in range(a + 1, k):
                cell = rough[a] * (len(self.coarse[b]) + 1) + rough[b]
                g, h = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
                gains.append((float((g * g / (h + 1)).sum()), a, b))
        self.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[: self.n_pairs]]
        self.grids = [np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)) for a, b in self.pairs]
        for _ in range(self.pair_rounds):
            for t, (a, b) in enumerate(self.pairs):
                p, shape = sigmoid(raw), self.grids[t].shape
                cell = rough[a] * shape[1] + rough[b]
                g = np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape)
                h = np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)
                step = self.rate * self._cross(g, h)
                self.grids[t] += step
                raw += step[rough[a], rough[b]]
        return self

    def _best_cut(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """Gain and place of the best split of a run of bins; place 0 is none."""
        if len(g) < 2:
            return 0.0, 0
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + self.least) + gr**2 / (hr + self.least) - g.sum() ** 2 / (h.sum() + self.least)
        k = int(gain.argmax())
        return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)

    def _tree(self, g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
        """A tree of up to three leaves over ordered bins, as a value a bin."""
        parts = [(0, len(g))]
        while len(parts) < leaves:
            best = max(((*self._best_cut(g[a:b], h[a:b]), a, b) for a, b in parts), key=lambda x: x[0])
            if not best[1]:
                break
            parts.remove((best[2], best[3]))
            parts += [(best[2], best[2] + best[1]), (best[2] + best[1], best[3])]
        out = np.zeros(len(g))
        for a, b in parts:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + self.least)
        return out

    def _cross(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree that cuts one axis and then the other on either side: up to four leaves of a grid."""
        best, found = -1.0, np.zeros_like(g)
        for turned in (False, True):
            gg, hh = (g.T, h.T) if turned else (g, h)
            _, k = self._best_cut(gg.sum(axis=1), hh.sum(axis=1))
            out, gain = np.zeros_like(gg), 0.0
            for rows in (slice(0, k), slice(k, None)):
                gs, hs = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
                _, c = self._best_cut(gs, hs)
                for columns in (slice(0, c), slice(c, None)):
                    value = gs[columns].sum() / (hs[columns].sum() + self.least)
                    out[rows, columns] = value
                    gain += value * gs[columns].sum()
            if gain > best:
                best, found = gain, out.T if turned else out
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            raw += values[np.searchsorted(edges, x[:, j], "left")]
        for (a, b), values in zip(self.pairs, self.grids, strict=True):
            raw += values[np.searchsorted(self.coarse[a], x[:, a], "left"), np.searchsorted(self.coarse[b], x[:, b], "left")]
        return sigmoid(raw)


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fit(sample: DataFrame) -> AdditiveModel | Constant:
    """A model from (doc_id, text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for at, to in steps(offsets):
                x = text_features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(at, to - at), *(pa.array(c) for c in x.T)], ["y", *FEATURES])

    rows = sample.mapInArrow(tidied(run), "y double, " + ", ".join(f"{f} double" for f in FEATURES)).orderBy("y", *FEATURES).toArrow()
    y = rows["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 1.0)
    return AdditiveModel().fit(np.stack([rows[f].to_numpy() for f in FEATURES], axis=1), y)


def score(docs: DataFrame, model: AdditiveModel | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = np.zeros(batch.num_rows)
            for at, to in steps(offsets):
                out[at:to] = model.score(text_features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["i", "score"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidied(run), f"i {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("i", id_col)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_out_fold: int = 2, threshold: float = 0.7, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held_out = crc_fold(id_col, folds) == held_out_fold
    model = fit(labelled_sample(docs, labels, label_col, ~held_out, most_labelled, id_col, text_col))
    return score(docs, model, id_col, text_col).select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
