"""Hard negatives by angular triangle filtering: bounds on scores from stored angles, exact scores only where they matter.

Each row keeps its norm and its angles to REFERENCES directions (rows far from each other, of a bounded sample). The
triangle inequality on the sphere gives, for a pair and a direction, |a - b| <= angle <= min(a + b, 2 pi - a - b); the
narrowest interval over all directions, as cosines times both norms and widened by more than all rounding, bounds the
integer score. Blocks of rows near one direction keep the extremes of their angles and norms, so that the same bounds
hold for an anchor against a whole block.

1. Positives. Per anchor and block the k-th best lower bound of rows of its label is a cutoff; only rows whose upper
   bound reaches it are scored. Each shard hands on its best, and the best of these are the positives.
2. Negatives. A positive's score p opens the window [low% of p, high% of p]. Blocks, then rows of other labels, whose
   bounds meet no window of the anchor are passed over; the others are scored as integers and held against each window.

Anchors are a stated query set against all rows: blocks of anchors meet every shard of rows, block against block. What a
task holds is two blocks; what is shuffled is the packed blocks and at most k results per anchor, window and shard.

Scores are exact in floats while below 2^53, else they are summed as Python integers and must fit a long (else the job
fails, loudly, as it does where scale * x is beyond a double).

Rows: null ids, labels and vectors, empty vectors and those with null or non-finite components take no part. Rows that
repeat an anchor's id are its own, not others; rows that repeat id, label and vector are one anchor, but each of them is
a candidate. Vectors of another length than the anchor's are none of its candidates. Zero vectors score 0. Ties go to the
smaller id. An anchor without positives, and a positive without negatives, give no rows. Labels are integers. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, tidied

#: Directions, and rows (of least hash) among which they are chosen.
REFERENCES, SAMPLE = 8, 2000
#: Vectors in a block of anchors and in a block of rows; rows of a shard, about, where the session's partitions would hold more.
ANCHOR_BLOCK, ROW_BLOCK, SHARD_ROWS = 256, 4096, 1 << 17
#: What float32 angles and cosines may be off at most, several times over.
ANGLE_SLACK, COSINE_SLACK = 4e-6, 1e-6
#: Most exact integer of a float.
EXACT = 1 << 53

ROWS = "dim int, id long, tag long, label long, vector binary, norm double, angles binary, cell int, near double"
PARTS = "ids binary, tags binary, labels binary, vectors binary, norms binary, angles binary"


def reference_directions(vectors: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """n unit vectors, each the one whose angles to those before it are widest."""
    norms = np.sqrt((vectors**2).sum(axis=1))
    units = vectors[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.zeros((0, vectors.shape[1]))
    chosen = [0]
    closest = units @ units[0]
    while len(chosen) < min(n, len(units)):
        chosen.append(int(np.argmin(closest)))
        closest = np.maximum(closest, units @ units[chosen[-1]])
    return units[chosen]


def angles_to(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """float32 angles of rows to directions; a zero vector's are right angles, any would do, as its bounds are 0."""
    cosines = vectors @ directions.T / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def _scores(low_angle: np.ndarray, high_angle: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers that no score is below or above, of products of norms from least to most; without bound where norms overflow."""
    top = np.cos(np.maximum(low_angle - ANGLE_SLACK, 0)).astype(float) + COSINE_SLACK
    bottom = np.cos(np.minimum(high_angle + ANGLE_SLACK, np.float32(np.pi))).astype(float) - COSINE_SLACK
    with np.errstate(invalid="ignore", over="ignore"):
        low = np.floor(bottom * np.where(bottom > 0, least, most) * (1 + 1e-9) - 1)
        high = np.ceil(top * np.where(top > 0, most, least) * (1 + 1e-9) + 1)
    sound = np.isfinite(low) & np.isfinite(high)
    return np.where(sound, low, -np.inf), np.where(sound, high, np.inf)


def pair_bounds(a: np.ndarray, a_norms: np.ndarray, b: np.ndarray, b_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all pairs, from angles and norms alone."""
    low = np.zeros((len(a), len(b)), np.float32)
    high = np.full((len(a), len(b)), np.float32(np.pi))
    for x, y in zip(a.T, b.T, strict=True):
        np.maximum(low, np.abs(x[:, None] - y[None, :]), out=low)
        total = x[:, None] + y[None, :]
        np.minimum(high, np.minimum(total, np.float32(2 * np.pi) - total), out=high)
    with np.errstate(over="ignore"):
        norms = a_norms[:, None] * b_norms[None, :]
    return _scores(low, high, norms, norms)


def block_bounds(a: np.ndarray, a_norms: np.ndarray, b: np.ndarray, b_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each a, bounds of its scores with all rows of b together, from the extremes of their angles and norms."""
    least, most = b.min(axis=0), b.max(axis=0)
    low = np.maximum(np.maximum(a - most, least - a), 0).max(axis=1, initial=0)
    ends = [np.minimum(a + x, np.float32(2 * np.pi) - a - x) for x in (least, most)]
    opposite = (np.float32(np.pi) - a >= least) & (np.float32(np.pi) - a <= most)
    high = np.where(opposite, np.float32(np.pi), np.maximum(*ends)).min(axis=1, initial=np.float32(np.pi))
    with np.errstate(over="ignore"):
        return _scores(low, high, a_norms * b_norms.min(), a_norms * b_norms.max())


class Side:
    """The vectors of one block."""

    def __init__(self, x: dict, prefix: str = ""):
        part = lambda name, kind: np.frombuffer(x[prefix + name], kind)
        self.ids, self.tags, self.labels, self.norms = part("ids", np.int64), part("tags", np.int64), part("labels", np.int64), part("norms", float)
        self.vectors = _unpacked(x[prefix + "vectors"], len(self.ids), x["dim"])
        self.angles = part("angles", np.float32).reshape(len(self.ids), -1)
        self.reach = np.abs(self.vectors).max(axis=0, initial=0)

    def exact_with(self, other: Side) -> bool:
        return bool(self.reach @ other.reach < EXACT)


def _packed(vectors: np.ndarray) -> list[bytes]:
    """Each vector as int16 where all its components fit, else as doubles."""
    small = np.abs(vectors).max(axis=1, initial=0) < 1 << 15
    return [v.astype(np.int16).tobytes() if s else v.tobytes() for v, s in zip(vectors, small, strict=True)]


def _joined(vectors: list[bytes], dim: int) -> bytes:
    """Packed vectors of one block as int16 if all are, else as doubles."""
    if all(len(v) == 2 * dim for v in vectors):
        return b"".join(vectors)
    return b"".join(v if len(v) == 8 * dim else np.frombuffer(v, np.int16).astype(float).tobytes() for v in vectors)


def _unpacked(vectors: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(vectors, np.int16 if len(vectors) == 2 * n * dim else float).reshape(n, dim).astype(float)


def exact_scores(q: np.ndarray, rows: np.ndarray, in_floats: bool) -> np.ndarray:
    """Inner products of one vector with rows, as integers of any size."""
    if in_floats:
        return (rows @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([sum(x * int(y) for x, y in zip(whole, row, strict=True)) for row in rows.tolist()] or np.zeros(0), object)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def positives(a: Side, b: Side, k: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """((anchor, rows, scores) of the best rows of the anchor's label in this block; how many were scored)."""
    out, scored, exact = [], 0, a.exact_with(b)
    for label in np.intersect1d(a.labels, b.labels):
        mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(b.labels == label)
        low, high = pair_bounds(a.angles[mine], a.norms[mine], b.angles[theirs], b.norms[theirs])
        other = a.ids[mine][:, None] != b.ids[theirs][None, :]
        low = np.where(other, low, -np.inf)
        cutoff = np.partition(low, -k, axis=1)[:, -k] if len(theirs) >= k else np.full(len(mine), -np.inf)
        wanted = other & (high >= cutoff[:, None])
        for i, anchor in enumerate(mine):
            rows = theirs[wanted[i]]
            scores = exact_scores(a.vectors[anchor], b.vectors[rows], exact)
            best, scored = best_of(scores, b.ids[rows], k), scored + len(rows)
            out.append((int(anchor), rows[best], scores[best]))
    return out, scored


def windows_of(scores: list[list[int]], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) of each anchor's windows that are not empty, overlapping ones as one, filled up with empty ones; widened to floats."""
    merged = []
    for own in scores:
        parts: list[list[float]] = []
        for a, b in sorted((-(-low * p // 100), high * p // 100) for p in own if low * p <= high * p):
            if parts and a <= parts[-1][1]:
                parts[-1][1] = max(parts[-1][1], b)
            else:
                parts.append([a, b])
        merged.append(parts)
    n = max(map(len, merged), default=0)
    table = np.full((2, len(scores), n), np.inf)
    table[1] *= -1
    for i, parts in enumerate(merged):
        for j, (a, b) in enumerate(parts):
            table[:, i, j] = np.nextafter(float(a), -np.inf), np.nextafter(float(b), np.inf)
    return table[0], table[1]


def _meets(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether [low, high] (a row an anchor) overlaps any of the anchor's windows."""
    out = np.zeros(low.shape, bool)
    for j in range(least.shape[1]):
        a, b = (x[:, j].reshape(-1, *[1] * (low.ndim - 1)) for x in (least, most))
        out |= (high >= a) & (low <= b)
    return out


def negatives(a: Side, b: Side, known: list[list[int]], low: int, high: int, k: int) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], int]:
    """((anchor, place of the positive, rows, scores) of the best rows in each window; how many pairs were scored)."""
    least, most = windows_of(known, low, high)
    asks = np.flatnonzero(_meets(*block_bounds(a.angles, a.norms, b.angles, b.norms), least, most))
    out, scored, exact = [], 0, a.exact_with(b)
    if not len(asks):
        return out, scored
    near = _meets(*pair_bounds(a.angles[asks], a.norms[asks], b.angles, b.norms), least[asks], most[asks])
    near &= (a.labels[asks][:, None] != b.labels[None, :]) & (a.ids[asks][:, None] != b.ids[None, :])
    for i, anchor in enumerate(asks.tolist()):
        rows = np.flatnonzero(near[i])
        if not len(rows):
            continue
        scores, scored = exact_scores(a.vectors[anchor], b.vectors[rows], exact), scored + len(rows)
        wide = scores.astype(object) if not exact or len(scores) and abs(scores).max() > EXACT // 100 else scores
        for place, p in enumerate(known[anchor]):
            inside = np.flatnonzero((100 * wide >= low * p) & (100 * wide <= high * p))
            if len(inside):
                best = inside[best_of(scores[inside], b.ids[rows[inside]], k)]
                out.append((anchor, place, rows[best], scores[best]))
    return out, scored


def _measured(scale: int, directions: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Integer vectors with norms, angles and the direction that is nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            lengths = lists.value_lengths().to_numpy()
            first, flat = np.cumsum(lengths) - lengths, lists.flatten().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                with np.errstate(over="ignore"):
                    vectors = np.floor(scale * flat[first[at][:, None] + np.arange(dim)])
                    if not np.isfinite(vectors).all():
                        raise OverflowError(f"a component times {scale} is beyond a double")
                    norms = np.sqrt((vectors**2).sum(axis=1))
                own = directions.get(int(dim), np.zeros((0, dim)))
                angles = angles_to(vectors, norms, own) if len(own) else np.zeros((len(at), 0), np.float32)
                cell = angles.argmin(axis=1) if len(own) else np.zeros(len(at), np.int64)
                near = angles[np.arange(len(at)), cell].astype(float) if len(own) else np.zeros(len(at))
                rows = pa.array(at)
                columns = [pa.array(np.full(len(at), dim), pa.int32()), *(batch.column(k).take(rows) for k in range(3)), pa.array(_packed(vectors), pa.binary()), pa.array(norms), pa.array([x.tobytes() for x in angles], pa.binary()), pa.array(cell, pa.int32()), pa.array(near)]
                yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in ROWS.split(", ")])

    return run


def _blocks(most: int, extra: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of up to `most` vectors of one length, in the order in which they come; with extra, lists of positives go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            number = lambda name: np.array([x[name] for x in rows], float if name == "norm" else np.int64).tobytes()
            row = {"dim": dim, "ids": number("id"), "tags": number("tag"), "labels": number("label"), "vectors": _joined([x["vector"] for x in rows], dim), "norms": number("norm"), "angles": b"".join(x["angles"] for x in rows)}
            fields = [("dim", pa.int32()), *((x.split(" ")[0], pa.binary()) for x in PARTS.split(", "))]
            if extra:
                row["known"] = [x["known"] for x in rows]
                fields.append(("known", pa.list_(pa.list_(pa.int64()))))
            return pa.RecordBatch.from_pylist([row], pa.schema(fields))

        for batch in batches:
            for x in batch.to_pylist():
                own = held.setdefault(x["dim"], [])
                own.append(x)
                if len(own) == most:
                    yield block(x["dim"])
        for dim in list(held):
            yield block(dim)

    return run


def _met(asking: DataFrame, blocks: DataFrame, shards: int) -> DataFrame:
    """Every block of anchors with every block of rows, shard by shard: the stated query set against all rows."""
    sent = asking.select("dim", *[F.col(c).alias(f"a_{c}") for c in asking.columns if c != "dim"], F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    return sent.join(blocks.hint("merge"), ["shard", "dim"]).drop("shard")


FOUND = pa.schema([(x, pa.int64()) for x in ("anchor_id", "tag", "place", "vec_id", "score")])
FOUND_DDL = "anchor_id long, tag long, place long, vec_id long, score long"


def _result(a: Side, b: Side, parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    n = [len(rows) for _, _, rows, _ in parts]
    anchors = np.repeat(np.array([x for x, *_ in parts], np.int64), n)
    rows = np.concatenate([r for *_, r, _ in parts]) if parts else np.zeros(0, np.int64)
    scores = [int(s) for *_, x in parts for s in x]
    return pa.RecordBatch.from_arrays([pa.array(a.ids[anchors]), pa.array(a.tags[anchors]), pa.array(np.repeat(np.array([x for _, x, *_ in parts], np.int64), n)), pa.array(b.ids[rows]), pa.array(scores, pa.int64())], schema=FOUND)


def _find_positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                a, b = Side(x, "a_"), Side(x)
                yield _result(a, b, [(i, 0, rows, scores) for i, rows, scores in positives(a, b, k)[0]])

    return run


def _find_negatives(low: int, high: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                a, b = Side(x, "a_"), Side(x)
                yield _result(a, b, negatives(a, b, x["a_known"], low, high, k)[0])

    return run


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    references: int = REFERENCES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives of a positive of score p: the best rows of other labels with low_percent * p <= 100 * score <= high_percent * p.
    label: the rows' label, by default the column of that name.
    """
    spark = vectors.sparkSession
    value = F.col(vector_col).cast("array<double>")
    sound = F.col("v").isNotNull() & F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), value.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = named.where(sound).select("id", F.xxhash64("label", "v").alias("tag"), "label", "v", "asks")
    n_rows = rows.count()
    # A share of the rows by hash, about twice the sample, so that tasks don't send as many each.
    few = rows.where(F.pmod(F.xxhash64("id", "tag"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 2 * SAMPLE / max(n_rows, 1)))).dropDuplicates(["id", "tag"])
    sample = few.orderBy(F.xxhash64("id", "tag"), "id", "tag").limit(SAMPLE).select("v").toArrow().column(0).to_pylist()
    directions = {n: reference_directions(np.array([v for v in sample if len(v) == n], float), references) for n in {len(v) for v in sample}}

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    measured = cut(rows.select("id", "tag", "label", "v").mapInArrow(tidied(_measured(scale, directions)), ROWS))
    shards = max(n, -(-n_rows // SHARD_ROWS))
    in_order = measured.repartition(shards).sortWithinPartitions("dim", "cell", "near")
    blocks = cut(in_order.mapInArrow(tidied(_blocks(ROW_BLOCK, False)), f"dim int, {PARTS}").withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(shards))))
    asked = rows.where("asks").select("id", "tag").distinct()
    anchors = cut(measured.join(asked, ["id", "tag"], "left_semi").dropDuplicates(["id", "tag", "label", "vector"]))
    asking = anchors.mapInArrow(tidied(_blocks(ANCHOR_BLOCK, False)), f"dim int, {PARTS}")

    found = _met(asking, blocks, shards).mapInArrow(tidied(_find_positives(n_positives)), FOUND_DDL)
    place = F.row_number().over(W.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id"))
    best = cut(found.withColumn("place", place).where(F.col("place") <= n_positives).withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}))
    known = best.groupBy(F.col("anchor_id").alias("id"), "tag").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("known"))
    again = anchors.join(known, ["id", "tag"]).withColumn("known", F.col("known.positive_score")).mapInArrow(tidied(_blocks(ANCHOR_BLOCK, True)), f"dim int, {PARTS}, known array<array<long>>")

    near = _met(again, blocks, shards).mapInArrow(tidied(_find_negatives(low_percent, high_percent, n_negatives)), FOUND_DDL)
    rank = F.row_number().over(W.partitionBy("anchor_id", "tag", "place").orderBy(F.desc("score"), "vec_id"))
    ranked = near.withColumn("rank", rank).where(F.col("rank") <= n_negatives).withColumn("place", F.col("place") + 1)
    return ranked.join(best, ["anchor_id", "tag", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5
"""
