"""Mixing sources to target weights, block by block.

A source's texts, in an order drawn by hash, are one stream of words that is cut into blocks of BLOCK words (of a
LEAST_BLOCKS-th of its words, and one at least, where that is less, so that small sources meet their targets as well); its
target is a quota of slots of that size. The mix is dealt to output shards. A shard's source counts are a multinomial draw with
the quotas as weights. What is drawn beyond a source's quota, counted by running sums over the shards, is drawn anew
from the sources that still lack slots; the few slots left after MULTINOMIAL_ROUNDS are drawn without replacement, so
each source gets its quota exactly. A source's slots of all shards, numbered in a row, walk through its blocks epoch by
epoch, each epoch in the order of a pseudorandom permutation of the block indexes, and are joined to the texts by block
index. How often a block is drawn times how much of it a text holds is what is taken.

Stream places come from sums per (source, bucket) and, inside a bucket, a running sum, so a source of any size is
spread over many tasks. Nothing is collected: what meets in one task is at most a row per source or per shard.

Targets: sources in order of code points, null last, weigh WEIGHTS in turn and share `share` of all words by weight;
a target stops at `most` times its source's words, and the excess is shared anew until none is above. A block is
drawn at most ceil(most) times, so with the default of 2 no document exceeds twice its size.

Rows: null text has size 0 and nothing taken; a null source is a source of its own; rows that repeat an id are mixed
as documents of their own, in an order that ties them by their text's hash, so reruns agree. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, tidied

BLOCK, LEAST_BLOCKS = 64, 64
WEIGHTS = (3, 1, 2)
#: Documents per bucket, about; and buckets of a source at most, as their sums are run through in one window.
BUCKET, MOST_BUCKETS = 256, 65_536
#: Slots per output shard, about; and shards at most, as a source's slots are numbered along them in one window.
SHARD, MOST_SHARDS = 4096, 65_536
#: Sources that share shards at most; further ones have shards of their own.
TOGETHER = 10_000
#: Rounds of multinomial draws, and how many slots may be left for the last draw at most (else there are further rounds).
MULTINOMIAL_ROUNDS, MOST_LEFT = 2, 1_000_000
#: Sources whose statistics are sent to all tasks at most.
MOST_SENT = 10_000
_SLOTS = 1 << 20


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, known, source_size, target) from (source, known, size); one row a source.

    The fixed point of resharing is a water level: sources whose cap is low for their weight stop at the cap, the
    others share the rest by weight. Sorted by cap per weight, the capped ones come first.
    """
    sums = cut(sizes.groupBy("source", "known").agg(F.sum("size").alias("source_size")))
    in_turn = W.orderBy(F.col("known").desc(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(in_turn) - 1) % len(weights) + 1)
    rows = sums.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    ordered = W.orderBy(F.col("cap") / F.col("weight"), "known", "source")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "all": F.sum("source_size").over(W.partitionBy()) * share,
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # Were all from this source on to share what the ones before leave: does this one stay under its cap?
    level = (F.col("all") - F.col("capped")) / F.col("open")
    rows = rows.withColumn("level", F.when(F.col("cap") > level * F.col("weight"), level)).withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("cap") / F.col("weight"))).over(W.partitionBy()))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("source", "known", "source_size", target.alias("target"))


COUNTS = "family long, shard long, k long, n long"


def _counts(family: int, shards: list[int], drawn: list[np.ndarray], ks: np.ndarray) -> pa.RecordBatch:
    table = np.array(drawn, np.int64).reshape(len(shards), len(ks))
    row, column = np.nonzero(table)
    columns = np.full(len(row), family), np.array(shards, np.int64)[row], ks[column], table[row, column]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["family", "shard", "k", "n"])


def _multinomial(seed: int, turn: int):
    """Each open shard's slots, dealt to the sources in proportion to what they lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ks, left = (np.array([y[c] for y in x["lacking"]], np.int64) for c in ("k", "left"))
                rng = np.random.default_rng([seed, turn, x["family"], x["shard"]])
                yield _counts(x["family"], [x["shard"]], [rng.multinomial(x["slots"], left / left.sum())], ks)

    return run


def _without_replacement(seed: int):
    """All open shards of a family, one after the other; exact, for few slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ks, left = (np.array([y[c] for y in x["lacking"]], np.int64) for c in ("k", "left"))
                rng = np.random.default_rng([seed, x["family"]])
                drawn = []
                for y in x["open"]:
                    drawn.append(rng.multivariate_hypergeometric(left, y["slots"]))
                    left = left - drawn[-1]
                yield _counts(x["family"], [y["shard"] for y in x["open"]], drawn, ks)

    return run


def draw_plan(quotas: DataFrame, seed: int, shard_slots: int = SHARD) -> DataFrame:
    """(family, k, shard, first, n): source k gives the n slots from `first` on, in its own count, to a shard.

    quotas: (k, quota), k from 0. Over all shards each source gives its quota, no more and no less.
    """
    lacking = cut(quotas.where("quota > 0").select(F.floor(F.col("k") / TOGETHER).alias("family"), "k", "quota", F.col("quota").alias("left")))
    sums = lacking.groupBy("family").agg(F.sum("quota").alias("total")).withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.expr(f"total div {shard_slots}"))))
    shards = sums.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    open_ = cut(shards.select("family", "shard", F.expr("total * (shard + 1) div shards - total * shard div shards").alias("slots")))
    n = int(quotas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan, turn = None, 0
    while slots := open_.agg(F.sum("slots")).first()[0]:
        arrays = lacking.where("left > 0").groupBy("family").agg(F.sort_array(F.collect_list(F.struct("k", "left"))).alias("lacking"))
        if turn >= MULTINOMIAL_ROUNDS and slots <= MOST_LEFT:
            rows = open_.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("shard", "slots"))).alias("open"))
            drawn = rows.join(arrays, "family").mapInArrow(tidied(_without_replacement(seed)), COUNTS)
        else:
            drawn = open_.repartition(n).join(arrays, "family").mapInArrow(tidied(_multinomial(seed, turn)), COUNTS)
        before = F.coalesce(F.sum("n").over(W.partitionBy("family", "k").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        kept = F.greatest(F.lit(0), F.least(F.col("n"), F.col("left") - F.col("before")))
        placed = cut(drawn.withColumn("before", before).join(lacking, ["family", "k"]).select("family", "k", "shard", (F.col("quota") - F.col("left") + F.col("before")).alias("first"), kept.alias("n"), (F.col("n") - kept).alias("beyond")))
        plan = placed.where("n > 0") if plan is None else plan.union(placed.where("n > 0"))
        open_ = cut(placed.where("beyond > 0").groupBy("family", "shard").agg(F.sum("beyond").alias("slots")))
        given = placed.groupBy("family", "k").agg(F.sum("n").alias("given"))
        lacking = cut(lacking.join(given, ["family", "k"], "left").select("family", "k", "quota", (F.col("left") - F.coalesce("given", F.lit(0))).alias("left")))
        turn += 1
    return plan.drop("beyond") if plan is not None else cut(lacking.select("family", "k", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("first"), "left").toDF("family", "k", "shard", "first", "n"))


def _blocks(seed: int):
    """The blocks of each row's slots: (k, block) with the number of times it is drawn there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, first, n, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(first, first + n, _SLOTS):
                    epoch, place = np.divmod(np.arange(at, min(at + _SLOTS, first + n)), blocks)
                    block, times = np.unique(_permuted(place, epoch, blocks, seed + 1000 * k), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), k)), pa.array(block), pa.array(times.astype(np.int64))], ["k", "block", "drawn"])

    return run


def _permuted(place: np.ndarray, epoch: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each epoch: four Feistel rounds on the next even power of two, walked until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = place.astype(np.uint64)
    keys = (epoch.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & 0xFFFFFFFF)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            f = (right + keys[todo] + np.uint64(r)) * np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ (f >> np.uint64(40) & mask)
        x[todo] = left << np.uint64(half) | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block: int = BLOCK,
    seed: int = 17,
) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    sized = cut(docs.select(F.col(id_col).alias("id"), F.coalesce(source, F.lit("")).alias("source"), source.isNotNull().alias("known"), words_of(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("tie")))
    width = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    named = targets(sized, weights, share, most).withColumn("width", width).withColumn("blocks", F.ceil(F.col("source_size") / F.col("width")))
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.floor(F.col("blocks") * most))).otherwise(F.lit(0))
    in_turn = W.orderBy(F.col("known").desc(), F.col("source"))
    named = cut(named.withColumns({"quota": quota, "k": (F.row_number().over(in_turn) - 1).cast("long")}))
    few = F.broadcast(named) if named.count() <= MOST_SENT else named
    plan = draw_plan(named.select("k", "quota"), seed)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = plan.join(few.select("k", "blocks"), "k").select("k", "first", "n", "blocks").repartition(n)
    drawn = slots.mapInArrow(tidied(_blocks(seed)), "k long, block long, drawn long").groupBy("k", "block").agg(F.sum("drawn").alias("drawn"))
    numbered = sized.join(few.select("source", "known", "k", "width"), ["source", "known"])
    none = numbered.where("size = 0").select("id", "k", "size", F.lit(0).cast("long").alias("taken"))
    out = none.union(_taken(numbered, drawn, seed))
    return out.join(few.select("k", "source_size", "target"), "k").select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _taken(sized: DataFrame, drawn: DataFrame, seed: int) -> DataFrame:
    """Places of the texts in their sources' streams, cut at borders of their sources' blocks and joined to the drawn ones by index."""
    keys = ["k", "bucket"]
    buckets = min(MOST_BUCKETS, max(1, sized.count() // BUCKET))
    dealt = sized.where("size > 0").withColumn("h", F.xxhash64("id", "tie", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    so_far = W.unboundedPreceding, -1
    held = dealt.groupBy(*keys).agg(F.sum("size").alias("held"))
    firsts = cut(held.withColumn("base", F.sum("held").over(W.partitionBy("k").orderBy("bucket").rowsBetween(*so_far))).select(*keys, F.coalesce("base", F.lit(0)).alias("base")))
    inside = F.sum("size").over(W.partitionBy(*keys).orderBy("h", "id", "tie", "size").rowsBetween(*so_far))
    placed = dealt.withColumn("inside", F.coalesce(inside, F.lit(0))).join(firsts, keys).withColumn("at", F.col("inside") + F.col("base"))
    end = F.col("at") + F.col("size")
    indexes = F.sequence(F.floor(F.col("at") / F.col("width")), F.floor((end - 1) / F.col("width")))
    parts = placed.select("id", "tie", "size", "k", "at", "width", F.explode(indexes).alias("block"))
    held_words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("width")) - F.greatest("at", F.col("block") * F.col("width"))
    # Without the hint Spark takes the few rows of the plan for the size of what is drawn from it, and would broadcast that.
    joined = parts.withColumn("words", held_words).join(drawn.hint("merge"), ["k", "block"], "left")
    found = joined.groupBy("id", "tie", "k", "size", "at").agg(F.sum(F.col("words") * F.coalesce("drawn", F.lit(0))).alias("taken"))
    return found.select("id", "k", "size", F.col("taken").cast("long"))
