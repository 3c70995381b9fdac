"""A bounded sample of labelled documents, and logistic helpers for models that are trained on it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most; those of least id hash.
MOST_LABELLED = 16_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, training: Column, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled rows of the training folds, the least by hash of the id.

    The rows' bound makes them safe to broadcast, so the documents are scanned but not shuffled. Where an id is on several
    rows, all of them count towards the bound.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & training)
    chosen = known.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "text").limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
