"""Exact top-k by inner product in three phases with one uniform threshold.

A vector's dimensions are parted into GROUPS groups. Of a shard's rows, each group keeps its own list: the rows in the
order of a code, the signs of CODE_BITS fixed sums over the group's components, so that rows alike in the group stand together.
1. Local score lists. Per query and group only the list's head is read: one row in HEAD_SHARE, those around the query's own code. Their
   scores are made in full. The k-th best of all shards' heads together is the query's cutoff, which k rows reach: safe.
2. The cutoff T goes to every shard. A row that reaches T has T / GROUPS or more in some group (the uniform threshold).
   Lists of partial scores are made group by group, but the last; a row goes on if its partial scores and the greatest
   value that the rest can add (the product of norms) reach T, and one of them can reach T / GROUPS. The others are out.
3. The remaining partial score of the rows that are left is made, row by row, and added: exact scores. Rows below T go,
   the k best of each shard are sent on, and the k best of these are the answer.

multiply_adds() tells how many products the phases take; queries times rows times dimensions is what comparing all takes.

Queries and rows travel in blocks of vectors packed as integers; each query block meets every shard, and a task holds
one block of either. What is shuffled is the blocks and at most k results per query and shard, in either round.

Components become floor(scale * x), x as double; products are exact in floats while |score| < 2^53, else they are
summed as Python integers (all rows are then left to phase 3) and must fit a long (else the job fails, loudly).

Rows: vectors that are null, empty or hold null or non-finite components take no part; so do rows with a null id, and
vectors of another length than the query's are no candidates of it. Rows that repeat a query's id count as the query's
own; repeated candidates of one id are all candidates and tie. Ties go to the smaller id. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, tidied

GROUPS = 4
#: One row of so many is in a list's head (LEAST_HEAD at least); and bits of the code that lists are ordered by.
HEAD_SHARE, LEAST_HEAD, CODE_BITS = 80, 8, 12
#: Vectors in a block of queries and in a block of candidates.
QUERY_BLOCK, ROW_BLOCK = 512, 4096
BLOCKS = "dim int, ids binary, vectors binary"


def _packed(most: int):
    """Blocks of up to `most` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[int]]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            ids, vectors = np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], ["dim", "ids", "vectors"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(len(v), [])
                own.append((i, v))
                if len(own) == most:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return run


def _open(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(-1, dim)


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats where every score is below 2^53, else as Python integers."""
    reach = int(np.dot(np.abs(q).max(axis=0, initial=0).astype(object), np.abs(c).max(axis=0, initial=0).astype(object)))
    kind = float if reach < 1 << 53 else object
    return q.astype(kind), c.astype(kind)


def _groups(dim: int) -> list[slice]:
    bounds = np.linspace(0, dim, GROUPS + 1).astype(int)
    return [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _codes(x: np.ndarray) -> np.ndarray:
    """The signs of CODE_BITS fixed sums of a group's components, as a number; integers so large that floats round them may get any."""
    signs = np.random.default_rng(11).choice([-1.0, 1.0], (x.shape[1], CODE_BITS))
    return (x.astype(float) @ signs >= 0) @ (1 << np.arange(CODE_BITS))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def _head_size(rows: int) -> int:
    return min(rows, max(LEAST_HEAD, rows // HEAD_SHARE))


def _list_heads(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(queries, rows read): of each group's list the rows around the query's code."""
    n = _head_size(len(c))
    parts = []
    for g in _groups(q.shape[1]):
        own, theirs = _codes(q[:, g]), _codes(c[:, g])
        order = np.argsort(theirs, kind="stable")
        middle = np.searchsorted(theirs[order], own, "left") + np.searchsorted(theirs[order], own, "right") >> 1
        parts.append(order[np.clip(middle - n // 2, 0, len(c) - n)[:, None] + np.arange(n)])
    return np.concatenate(parts, axis=1)


def _phase_one(k: int):
    """The k best totals among the rows that a query's list heads name, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                q_ids, q = _open(x["q_ids"], x["q_vectors"], x["dim"])
                ids, c = _open(x["ids"], x["vectors"], x["dim"])
                heads = _list_heads(q, c)
                q, c = _exact(q, c)
                totals = []
                for i, own in enumerate(q_ids):
                    rows = np.unique(heads[i])
                    rows = rows[ids[rows] != own]
                    totals.append([int(t) for t in np.sort(c[rows].dot(q[i]))[::-1][:k]])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array([x["dim"]] * len(q_ids), pa.int32()), pa.array(totals, pa.list_(pa.int64()))], ["query_id", "dim", "totals"])

    return run


def sufficient(q: np.ndarray, c: np.ndarray, cutoffs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phase 2: (query, row, score so far) of the pairs that are not out before the last group, and the multiply-adds taken."""
    groups = _groups(q.shape[1])
    if q.dtype == object:
        i, j = np.divmod(np.arange(len(q) * len(c)), len(c))
        return i, j, np.zeros(len(i), object), 0
    share = cutoffs / GROUPS
    norm = lambda x, g: np.sqrt((x[:, g] ** 2).sum(axis=1)) * (1 + 1e-9)  # noqa: E731  rounding may only let more through
    sums, some = np.zeros((len(q), len(c))), np.zeros((len(q), len(c)), bool)
    for g in groups[:-1]:
        part = q[:, g] @ c[:, g].T
        sums += part
        some |= part >= share[:, None]
    rest = norm(q, groups[-1])[:, None] * norm(c, groups[-1])[None, :]
    i, j = np.nonzero((sums + rest >= cutoffs[:, None]) & (some | (rest >= share[:, None])))
    return i, j, sums[i, j], len(q) * len(c) * groups[-2].stop


def resolved(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, so_far: np.ndarray, at_once: int = 1 << 18) -> tuple[np.ndarray, int]:
    """Phase 3: exact scores of the pairs that are left, and the multiply-adds taken."""
    g = slice(0, q.shape[1]) if q.dtype == object else _groups(q.shape[1])[-1]
    parts = [(q[i[a : a + at_once], g] * c[j[a : a + at_once], g]).sum(axis=1) for a in range(0, len(i), at_once)]
    return so_far + (np.concatenate(parts) if parts else 0), len(i) * (g.stop - g.start)


def multiply_adds(q: np.ndarray, c: np.ndarray, cutoffs: np.ndarray) -> int:
    """Products that all phases take for these queries, rows and cutoffs."""
    q, c = _exact(q, c)
    heads = len(q) * _head_size(len(c)) * GROUPS * q.shape[1]
    i, j, so_far, taken = sufficient(q, c, cutoffs)
    return heads + taken + resolved(q, c, i, j, so_far)[1]


def _phases_two_and_three(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                q_ids, q = _open(x["q_ids"], x["q_vectors"], x["dim"])
                ids, c = _open(x["ids"], x["vectors"], x["dim"])
                q, c = _exact(q, c)
                known = dict(x["cutoffs"] or ())
                cutoffs = np.array([known.get(int(i), -np.inf) for i in q_ids], float)  # under k other rows have no cutoff
                i, j, so_far, _ = sufficient(q, c, cutoffs)
                score, _ = resolved(q, c, i, j, so_far)
                good = (score >= cutoffs[i]).astype(bool) & (ids[j] != q_ids[i])
                i, j, score = i[good], j[good], score[good]
                bounds = np.searchsorted(i, np.arange(len(q_ids) + 1))
                for n, own in enumerate(q_ids):
                    rows, own_scores = j[bounds[n] : bounds[n + 1]], score[bounds[n] : bounds[n + 1]]
                    best = _best(own_scores, ids[rows], k)
                    if len(best):
                        yield pa.RecordBatch.from_arrays([pa.array([int(own)] * len(best), pa.int64()), pa.array(ids[rows[best]]), pa.array([int(s) for s in own_scores[best]], pa.int64())], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all other rows."""
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(vector_col).cast("array<double>")
    sound = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(value, lambda x: F.floor(x * scale)).alias("v"), is_query.alias("asks"))
    blocks = cut(rows.select("id", "v").repartition(n).mapInArrow(tidied(_packed(ROW_BLOCK)), BLOCKS).withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(n))))
    asked = rows.where("asks").groupBy("id", "v").agg(F.lit(1)).select("id", "v")
    queries = cut(asked.mapInArrow(tidied(_packed(QUERY_BLOCK)), BLOCKS).toDF("dim", "q_ids", "q_vectors").withColumn("block", F.monotonically_increasing_id()))
    # Every query block meets every shard: the stated query set against all rows, block by block.
    sent = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = sent.join(blocks, ["shard", "dim"])
    heads = met.select("dim", "q_ids", "q_vectors", "ids", "vectors").mapInArrow(tidied(_phase_one(k)), "query_id long, dim int, totals array<long>")
    every = heads.select("query_id", "dim", F.explode("totals").alias("total"))
    place = F.row_number().over(W.partitionBy("query_id", "dim").orderBy(F.desc("total")))
    cutoffs = cut(every.withColumn("place", place).where(F.col("place") == k).select("query_id", "dim", F.col("total").alias("cutoff")))
    ids_of = queries.mapInArrow(tidied(_query_ids), "block long, dim int, query_id long")
    known = ids_of.join(cutoffs, ["query_id", "dim"]).groupBy("block").agg(F.map_from_entries(F.collect_set(F.struct("query_id", "cutoff"))).alias("cutoffs"))
    again = sent.join(known, "block", "left").join(blocks, ["shard", "dim"])
    found = again.select("dim", "q_ids", "q_vectors", "cutoffs", "ids", "vectors").mapInArrow(tidied(_phases_two_and_three(k)), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            ids = np.frombuffer(x["q_ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x["block"]] * len(ids), pa.int64()), pa.array([x["dim"]] * len(ids), pa.int32()), pa.array(ids)], ["block", "dim", "query_id"])


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
