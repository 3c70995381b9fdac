"""Toxicity: a linear classifier on character n-grams, each scaled by its naive Bayes log-count ratio.

Grams are the strings of 4, 6 and 8 bytes of the text with A-Z lowered, hashed to 2^slot_bits slots; a document has a gram
or not. On a bounded sample of labelled texts (labelled.MOST_LABELLED) Spark counts in how many toxic and other documents
each slot occurs; the slots that tell the classes apart best are kept, their log-count ratios scale them, and a logistic
regression with an L2 penalty is fitted on the sample's kept slots, until its gradient is nought. Whole texts are then
scored by one narrow pass of table look-ups.

Parameters that bound the model, not the rows: `features` slots are kept (more cost memory of the fit and may overfit; a
word that fewer than `least_docs` sampled documents hold is not learned), and of 2^slot_bits slots some are shared by
several grams (with 20 bits and half a million different grams about a third of them), which then count as one.

Rows: a document that is labelled twice counts twice, also with either label. Null and empty texts get the score of no gram at all, as does every text of a table without usable labels (then
0). Null ids count as fold 0. Rows that repeat are scored alike; an empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_codes, crc_fold, cut, steps, text_bytes, window_hashes, tidied
from .labelled import MOST_LABELLED, labelled_sample, sigmoid
from .word_shingles import _LOWER

SIZES = (4, 6, 8)
#: The model's default bounds: see above.
SLOT_BITS, FEATURES, LEAST_DOCS = 20, 3000, 4
PENALTY = 1.0
#: Parts of the slots' counts that are added up apart, and tasks that count the sample at most.
PARTS, TASKS = 64, 16


def _slots(data: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per gram size the slot of the gram at each place."""
    hashes = window_hashes(byte_codes(_LOWER[data]), list(SIZES))
    for n in SIZES:
        yield n, ((hashes[n] * U64(2 * n + 1)) >> U64(64 - bits)).astype(np.int32)


def _found(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) where wanted[slot] is a feature's number plus one, or 0."""
    keys = []
    for n, slots in _slots(data, len(wanted).bit_length() - 1):
        feature = wanted[slots]
        at = np.flatnonzero(feature)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + n <= offsets[text + 1]
        keys.append(text[inside] << 24 | (feature[at[inside]].astype(np.int64) - 1))
    keys = np.unique(np.concatenate(keys))
    return keys >> 24, keys & 0xFFFFFF


def _slot_counts(bits: int):
    """In how many texts of each label a slot occurs: PARTS rows a task, each with the counts of its part of the slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int32)
        stamp = np.arange(1, (1 << bits) + 1, dtype=np.int32)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            y = batch.column(2).to_numpy()
            for at, to in steps(offsets):
                text, slot = _found(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], stamp)
                for label in (0, 1):
                    counts[label] += np.bincount(slot[y[at:to][text] == label], minlength=1 << bits).astype(np.int32)
        parts = [[x.tobytes() for x in np.split(counts[label], PARTS)] for label in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], ["part", "toxic", "other"])

    return run


def _best_of_part(n1: int, n0: int, features: int, least_docs: int):
    """The slots of a part whose occurrence tells the classes apart best, as a chi-squared test ranks them."""

    def run(rows: pa.Table) -> pa.Table:
        toxic, other = (sum(np.frombuffer(x, np.int32).astype(np.int64) for x in rows[c].to_pylist()) for c in ("toxic", "other"))
        p, q, overall = toxic / n1, other / n0, (toxic + other) / (n1 + n0)
        apart = (p - q) ** 2 / (overall * (1 - overall) + 1e-6)
        at = np.flatnonzero(toxic + other >= least_docs)
        at = at[np.lexsort((at, -apart[at]))[:features]]
        return pa.table({"slot": at + rows["part"][0].as_py() * len(toxic), "toxic": toxic[at], "other": other[at], "apart": apart[at]})

    return run


def _wanted(slots: np.ndarray, bits: int) -> np.ndarray:
    wanted = np.zeros(1 << bits, np.int32)
    wanted[slots] = np.arange(1, len(slots) + 1)
    return wanted


def fit(sample: DataFrame, features: int = FEATURES, least_docs: int = LEAST_DOCS, slot_bits: int = SLOT_BITS) -> dict:
    """Slots, their weights (ratio times coefficient) and the intercept, from (doc_id, text, y)."""
    n = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = cut(sample.repartition(min(n, TASKS)))
    classes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = classes.get(1.0, 0), classes.get(0.0, 0)
    if not n1 or not n0:
        return {"slots": np.zeros(0, np.int64), "weights": np.zeros(0), "base": -40.0 if not n1 else 40.0, "bits": slot_bits}
    counts = sample.mapInArrow(tidied(_slot_counts(slot_bits)), "part int, toxic binary, other binary")
    apart = counts.groupBy("part").applyInArrow(_best_of_part(n1, n0, features, least_docs), "slot long, toxic long, other long, apart double")
    best = apart.orderBy(F.desc("apart"), "slot").limit(features).collect()
    if not best:
        return {"slots": np.zeros(0, np.int64), "weights": np.zeros(0), "base": float(np.log(n1 / n0)), "bits": slot_bits}
    slots, toxic, other = (np.array([r[k] for r in best], float) for k in ("slot", "toxic", "other"))
    slots = slots.astype(np.int64)
    ratio = np.log((toxic + 1) / (n1 + 2)) - np.log((other + 1) / (n0 + 2))
    wanted = _wanted(slots, slot_bits)

    def own_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for at, to in steps(offsets):
                text, feature = _found(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], wanted)
                bounds = np.searchsorted(text, np.arange(to - at + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(at, to - at), pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))], ["y", "features"])

    rows = sample.mapInArrow(tidied(own_features), "y double, features array<int>").toArrow()
    y, lists = rows["y"].to_numpy(), rows["features"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    columns, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    weights, base = _logistic(columns, bounds, ratio[columns], y, len(slots))
    return {"slots": slots, "weights": weights * ratio, "base": base, "bits": slot_bits}


def _logistic(columns: np.ndarray, bounds: np.ndarray, values: np.ndarray, y: np.ndarray, n: int, rounds: int = 1000, small: float = 1e-6) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on sparse rows: L-BFGS steps that each lower the loss, until no slope exceeds `small`."""
    rows = np.repeat(np.arange(len(y)), np.diff(bounds))

    def loss_and_slope(w: np.ndarray) -> tuple[float, np.ndarray]:
        raw = np.bincount(rows, values * w[columns], len(y)) + w[n]
        error = sigmoid(raw) - y
        slope = np.append(np.bincount(columns, values * error[rows], n) + PENALTY * w[:n], error.sum()) / len(y)
        return float((np.logaddexp(0, raw) - y * raw).mean() + PENALTY * (w[:n] @ w[:n]) / 2 / len(y)), slope

    w = np.append(np.zeros(n), np.log(y.mean() / (1 - y.mean())))
    (loss, slope), past = loss_and_slope(w), []
    for _ in range(rounds):
        if np.abs(slope).max() <= small:
            break
        way, taken = -slope, []
        for s, z, r in reversed(past):
            taken.append(r * (s @ way))
            way = way - taken[-1] * z
        if past:
            s, z, _ = past[-1]
            way = way * (s @ z) / (z @ z)
        for (s, z, r), t in zip(past, reversed(taken), strict=True):
            way = way + s * (t - r * (z @ way))
        step, down = 1.0, slope @ way
        while (new := loss_and_slope(w + step * way))[0] > loss + 1e-4 * step * down and step > 1e-12:
            step /= 2
        if new[0] >= loss:  # nothing lower within the precision of floats
            break
        s, z = step * way, new[1] - slope
        if s @ z > 0:
            past = [*past[-9:], (s, z, 1 / (s @ z))]
        w, (loss, slope) = w + s, new
    return w[:n], float(w[n])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, in one narrow pass."""
    wanted, weights, base = _wanted(model["slots"], model["bits"]), model["weights"], model["base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = np.full(batch.num_rows, base)
            for at, to in steps(offsets):
                text, feature = _found(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], wanted)
                out[at:to] += np.bincount(text, weights[feature], to - at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(out))], ["i", "score"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidied(run), f"i {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("i", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out_fold: int = 0, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held_out = crc_fold(id_col, folds) == held_out_fold
    model = fit(labelled_sample(docs, labels, label_col, ~held_out, most_labelled, id_col, text_col))
    return score(docs, model, id_col, text_col).select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
