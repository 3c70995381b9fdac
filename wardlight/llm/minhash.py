"""Near-duplicate documents: universal-hash minima, banding, signature screening, exact confirmation, components.

1. One narrow pass gives each text its shingle-set size, a 128-bit key of the set, the band hashes of its minima
   and a signature of one byte a minimum. Texts of equal sets form a class; its least id stands for it.
2. Buckets (equal band hashes) that hold two classes or more are kept. Each member is paired with the bucket's
   least member: a row per member, never all pairs of a bucket.
3. Pairs whose signatures agree too little for the threshold are dropped; the others are confirmed on the full sets.
4. Large-star and small-star alternate over the confirmed links. Where a bucket's members are still in different
   components, those outside its largest one are compared with the whole bucket: as pairs where they are few, else
   as blocks of texts against blocks of texts. So a pair that shares a bucket and could join
   two components is always tested, however large the bucket is.

With 40 bands of 6 a pair at similarity 0.8 shares no bucket with a chance of 5e-6, and one at 0.3 shares one with 0.03.

Rows: null texts and texts without words have the empty set and stand alone. Equal rows share a class; rows that
repeat one doc_id get one component and are kept or not together. A null doc_id takes no part as representative:
it gets its class's component, null in a class of null ids. Ids are longs, or texts of digits; others fail the job.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, hint_cleaning, mix, send_fewer_texts, steps, text_bytes, tidied
from .components import connected_components, dealt_anew
from .word_shingles import shingle_sets

#: Bands and minima of a band.
BANDS, ROWS = 40, 6
#: A pair's signatures may agree this much less than the threshold; five standard deviations at 240 minima.
SLACK = 0.13
#: Members outside a bucket's largest component that are compared with all of the bucket at once.
OUTSIDE = 4
#: Texts of a block, about, where larger remainders are compared block against block; a task's share of a group is at most
#: so many blocks that ask and so many that are held against them, so a larger group is more shares, not larger ones.
BLOCK, ASKING, HELD = 64, 64, 16
#: Ids of candidate pairs that are sent to all tasks at most (8 bytes each), so that the texts needn't be shuffled.
MOST_SENT = 200_000


def _minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The n least values of (a x + b) mod 2^64, for n fixed pairs of an odd a and b, of each non-empty set."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x632BE59BD9B4E019))
    a, b = seeds[:n] | U64(1), seeds[n:]
    out = np.empty((len(sets), n), U64)
    at = 0
    while at < len(sets):  # pieces that fit a cache
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 20_000):
            size += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to])
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]], dtype=np.int64)])
        for k in range(n):
            out[at:to, k] = np.minimum.reduceat(x * a[k] + b[k], first)
        at = to
    return out


def _features(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for at, to in steps(offsets):
                sets = shingle_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], width)
                size = np.array([len(s) for s in sets])
                low = _minima(full, bands * rows) if (full := [s for s in sets if len(s)]) else np.zeros((0, bands * rows), U64)
                key = np.zeros((len(sets), 2), U64)
                band = [[] for _ in sets]
                mark = [b""] * len(sets)
                grouped = np.zeros((len(full), bands), U64) + np.arange(bands, dtype=U64)
                for r in range(rows):
                    grouped = mix(grouped * U64(31) + low[:, r::rows])
                grouped, marks = grouped.view(np.int64), (mix(low) & U64(255)).astype(np.uint8)
                for k, i in enumerate(np.flatnonzero(size)):
                    key[i] = mix(sets[i]).sum(dtype=U64), mix(sets[i] + U64(0x5851F42D4C957F2D)).sum(dtype=U64)
                    band[i], mark[i] = grouped[k], marks[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(size, pa.int64()), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)), pa.array(band, pa.list_(pa.int64())), pa.array(mark, pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "bands", "mark"],
                )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for at, to in steps(offsets):
                sets = shingle_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], width)
                lengths = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(lengths), pa.array(values))], ["id", "shingles"])

    return run


def _screened(pairs: DataFrame, marks: DataFrame, least: float, minima: int) -> DataFrame:
    """Pairs whose signatures agree in at least that share of the minima."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, minima) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array((x == y).mean(axis=1) >= least)) for c in batch.columns[:2]], ["a", "b"])

    a, b = (marks.select(F.col("id").alias(k), F.col("mark").alias(f"mark_{k}")) for k in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "mark_a", "mark_b").mapInArrow(tidied(run), "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of the full sets, made anew from the texts of these ids alone."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = cut(ids)
    few = ids.count() <= MOST_SENT
    texts = docs.join(F.broadcast(ids) if few else dealt_anew(ids), "id", "left_semi").select("id", "text")
    sets = cut(texts.mapInArrow(tidied(_full_sets(width)), "id long, shingles array<long>"))
    with_b = pairs.join(sets.withColumnsRenamed({"id": "b", "shingles": "y"}), "b")
    both = with_b.join(sets.withColumnsRenamed({"id": "a", "shingles": "x"}), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def _across(shared: DataFrame, labels: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Members (bucket, id, component) of buckets that hold several components, and per such bucket its largest component
    and how many members are outside it. None if there is no such bucket."""
    if labels is None:
        now = shared.withColumn("component", F.col("id"))
    else:
        now = shared.join(labels, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = now.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    members = cut(now.join(dealt_anew(mixed), "bucket", "left_semi"))
    if members.isEmpty():
        return None, None
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"))
    return members, cut(sizes.select("bucket", F.col("main.component").alias("main"), (F.col("all") - F.col("main.n")).alias("outside")))


def _opened(block: pa.StructArray, minima: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, components, signatures, and all shingles with the bounds of each text's."""
    lists = block.field("shingles")
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    marks = np.frombuffer(b"".join(block.field("mark").to_pylist()), np.uint8).reshape(-1, minima)
    return block.field("id").to_numpy(), block.field("component").to_numpy(), marks, lists.flatten().to_numpy(), bounds


def _compared_in_blocks(own: DataFrame, docs: DataFrame, marks: DataFrame, width: int, percent: int, least: float, minima: int) -> DataFrame:
    """Links between what is outside the largest component of its buckets and all members of these buckets.

    own: distinct (main, id, component). Outside texts are a set of queries against all members, block against block of
    about BLOCK texts; the compared texts' full sets are in the blocks, so only links come out. The blocks of one main
    component are dealt out in shares of ASKING by HELD blocks.
    """
    ids = cut(own.select("id").distinct())
    texts = docs.join(F.broadcast(ids) if ids.count() <= MOST_SENT else dealt_anew(ids), "id", "left_semi").select("id", "text")
    sets = cut(texts.mapInArrow(tidied(_full_sets(width)), "id long, shingles array<long>"))
    parts = own.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.ceil(F.count_if(F.col("component") != F.col("main")) / BLOCK).alias("asking"))
    rows = cut(own.join(dealt_anew(parts), "main").join(sets, "id").join(marks, "id"))
    block, part_of = F.collect_list(F.struct("id", "component", "shingles", "mark")), lambda n: F.pmod(F.xxhash64("id"), F.col(n)).alias("part")
    share = lambda n, size: F.floor(n / size)
    every = lambda n, size: F.explode(F.sequence(F.lit(0).cast("long"), share(F.col(n) - 1, size)))
    asks = rows.where("component <> main").groupBy("main", part_of("asking"), "parts").agg(block.alias("asks")).select("main", share(F.col("part"), ASKING).alias("chunk"), every("parts", HELD).alias("salt"), "asks")
    held = rows.where("asking > 0").groupBy("main", part_of("parts"), "asking").agg(block.alias("held")).select("main", share(F.col("part"), HELD).alias("salt"), every("asking", ASKING).alias("chunk"), "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x_ids, x_of, x_marks, x, x_at = _opened(batch.column(0)[k].values, minima)
                y_ids, y_of, y_marks, y, y_at = _opened(batch.column(1)[k].values, minima)
                found = []
                for i in range(len(x_ids)):
                    near = ((y_marks == x_marks[i]).mean(axis=1) >= least) & (y_of != x_of[i])
                    mine = x[x_at[i] : x_at[i + 1]]
                    for j in np.flatnonzero(near):
                        theirs = y[y_at[j] : y_at[j + 1]]
                        common = len(np.intersect1d(mine, theirs, assume_unique=True))
                        if 100 * common >= percent * (len(mine) + len(theirs) - common):
                            found.append(sorted((int(x_ids[i]), int(y_ids[j]))))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return asks.join(dealt_anew(held), ["main", "salt", "chunk"]).select("asks", "held").mapInArrow(tidied(run), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    send_fewer_texts(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = cut(texts.mapInArrow(tidied(_features(width, bands, rows)), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, mark binary"))
    keys = ["k1", "k2", "n_shingles"]
    some = seen.where("n_shingles > 0")
    classes = cut(some.groupBy(*keys).agg(F.min("doc_id").alias("rep")))
    reps = classes.where("rep IS NOT NULL").select(F.col("rep").alias("doc_id"), *keys)
    speakers = cut(some.join(reps, ["doc_id", *keys], "left_semi").select(F.col("doc_id").alias("id"), "bands", "mark"))

    rows_of = speakers.select("id", F.explode("bands").alias("bucket"))
    ends = rows_of.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("bucket", "pivot")
    shared = cut(rows_of.join(dealt_anew(ends), "bucket").select("bucket", "id", "pivot").distinct())

    least, marks = percent / 100 - SLACK, speakers.select("id", "mark")

    def tested(found: DataFrame, links: DataFrame | None, before: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        found = cut(found.join(before, ["a", "b"], "left_anti") if before is not None else found)
        close = cut(_screened(found, marks, least, bands * rows))
        if not close.isEmpty():
            fresh = cut(_confirmed(close, texts, width, percent))
            links = fresh if links is None else links.union(fresh)
        hint_cleaning(docs.sparkSession)
        return links, found

    links, stars = tested(shared.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")), None, None)
    if links is not None:  # from here on each component is a star
        links = cut(connected_components(links)).toDF("a", "b")
    members, sizes = _across(shared.select("bucket", "id"), links.toDF("node", "component") if links is not None else None)
    if members is not None:
        small, large = sizes.where(F.col("outside") <= OUTSIDE), sizes.where(F.col("outside") > OUTSIDE)
        alone = members.join(dealt_anew(small.select("bucket", "main")), "bucket").where("component <> main").select("bucket", F.col("id").alias("a"), F.col("component").alias("c"))
        pairs = dealt_anew(alone).join(members, "bucket").where("c <> component").select("a", F.col("id").alias("b"))
        links, _ = tested(pairs, links, stars)
        rest = cut(members.join(dealt_anew(large.select("bucket", "main")), "bucket").select("main", "id", "component").distinct())
        if not rest.isEmpty():
            fresh = cut(_compared_in_blocks(rest, texts, marks, width, percent, least, bands * rows))
            links = fresh if links is None else links.union(fresh)

    out = seen.select("doc_id", *keys)
    if links is not None:
        labels = connected_components(links)
        classes = cut(classes.join(labels, F.col("rep") == F.col("node"), "left").select(*keys, F.coalesce("component", "rep").alias("component_id")))
    else:
        classes = classes.withColumnRenamed("rep", "component_id")
    out = out.join(classes, keys, "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(percent: int = 80) -> str:
    """Two-word shingles in DuckDB's SQL, by a join on shingles."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
