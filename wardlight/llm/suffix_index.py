"""Repeated byte strings: a logarithmic family of sampled suffix arrays, and the removal of what it finds.

Suffixes. Every window of `match` bytes names one anchor inside it by content alone (the least hash of its 64-byte
strings), so equal windows have equal anchors at equal offsets, and only the suffixes at anchors are indexed, about
one in (match - 64) / 2 bytes. Suffixes are in the order of their first 8 bytes and then of k, a fingerprint of the first 64.

Family. Documents come in batches. A batch's suffix array is its suffixes in that order, counted, dealt out by ranges
and sorted. It is merge-scanned against every level that is there: an entry on both sides is a common prefix of 64 bytes or
more, which each match of `match` bytes has at its anchor. What the scans of all batches found is what repeats. Then the
batch's array becomes a level, and equal-sized levels merge into the next, as a binary counter carries. A string that
millions of documents share is one entry of a level.

Resolution. Where a suffix repeats, r is a fingerprint of all the text that the windows of its anchor cover (its run).
Runs that repeat as a whole are spans at once. The text of other runs whose k repeats goes to their k's group, where windows are compared one by one; groups of over GROUP runs are dealt out by the content of blocks of windows.
Fingerprints have 64 bits for k and 64 more for r or for a window.

Rows: strings are UTF-8 bytes, matches never cross texts. Null text is empty; texts below `match` bytes stay whole.
Rows that repeat the id and the text are two documents that equal each other, so what is long enough goes from both.
Rows that repeat the id alone are told apart by their text; null ids work alike. Ids are longs, or texts of digits; others fail the job. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_windows import Windows
from .common import Tables, U64, hint_cleaning, mix, send_fewer_texts, slices, steps, text_bytes, tidied
from .components import dealt_anew

#: Runs of one k that one task compares; larger groups are dealt out by content, see _compare_blocks.
GROUP = 256
#: Rows that a task takes together while it walks through groups.
TOGETHER = 500


def _texts(docs: DataFrame, id_col: str, text_col: str, carried: str | None = None) -> DataFrame:
    """Texts with a key of two longs that tells rows apart unless they are equal; id is the carried column."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = F.col(id_col).cast("long")
    return docs.select(F.coalesce(known, F.lit(0)).alias("u1"), F.xxhash64(text, known.isNull()).alias("u2"), F.col(carried or id_col).alias("id"), text.alias("text"))


def _suffixes(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for at, to in steps(offsets):
                w = Windows(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], match)
                text, anchor, first, last = w.runs()
                base, row = w.offsets[text], pa.array(at + text)
                # The anchor's place, how far before it the run's windows begin and end, in one long.
                pack = (anchor - base) << 24 | (anchor - first) << 12 | (anchor - last)
                head = np.zeros(len(anchor), U64)
                for i in range(8):
                    head = head << U64(8) | w.data[anchor + i].astype(U64)
                head ^= U64(1 << 63)  # as signed numbers they are in the order of the bytes
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(pack), pa.array(head.view(np.int64)), pa.array(w.places[anchor].view(np.int64)), pa.array(w.hash(first, last + match, 1).view(np.int64))],
                    ["u1", "u2", "pack", "head", "k", "r"],
                )

    return run


def _unpack(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of a run."""
    anchor = pack >> 24
    return anchor - (pack >> 12 & 0xFFF), anchor - (pack & 0xFFF)


class SuffixFamily:
    """Levels of counted, sorted suffixes (head, k, n); level i has the suffixes of 2^i batches."""

    def __init__(self, spark: SparkSession, tables: Tables | None = None):
        self.tables = tables or Tables(spark)
        self.levels: dict[int, DataFrame] = {}
        self.found: list[DataFrame] = []

    def _array(self, counted: DataFrame) -> DataFrame:
        """Sorted ranges of suffixes, written; entries that both of two levels have become one."""
        n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = counted.repartitionByRange(n, "head", "k").groupBy("head", "k").agg(F.sum("n").alias("n"))
        return self.tables.keep(ranges.sortWithinPartitions("head", "k"))

    @staticmethod
    def merge_scan(array: DataFrame, level: DataFrame) -> DataFrame:
        """Suffixes (head, k) that both have: both sides are walked in their order, as a merge join does."""
        return array.select("head", "k").join(level.select("head", "k").hint("merge"), ["head", "k"])

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Adds a batch of (head, k); returns the repeated suffixes (head, k) that it brings: inside it, or with any level."""
        array = self._array(suffixes.groupBy("head", "k").agg(F.count("*").alias("n")))
        found = array.where("n > 1").select("head", "k")
        for level in self.levels.values():
            found = found.union(self.merge_scan(array, level))
        self.found.append(self.tables.keep(found))
        rank = 0
        while rank in self.levels:
            level = self.levels.pop(rank)
            merged = self._array(array.union(level))
            self.tables.drop(array)
            self.tables.drop(level)
            array, rank = merged, rank + 1
        self.levels[rank] = array
        hint_cleaning(array.sparkSession)
        return self.found[-1]

    def matches(self) -> DataFrame:
        """k of each suffix that any scan found to repeat."""
        rows = self.found[0]
        for more in self.found[1:]:
            rows = rows.union(more)
        return rows.select("k").distinct()


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in compressed form, to be shuffled."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in (part for whole in batches for part in slices(whole)):
        raw = [(x.as_py() or "").encode() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in raw], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], ["u1", "u2", "id", "n_bytes", "squeezed"])


def _open(squeezed: list[bytes], sizes: list[int]) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(x, n, asbytes=True) if n else b"" for x, n in zip(squeezed, sizes, strict=True)]


def _pieces(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            out = [], [], [], [], [], [], [], []
            for u1, u2, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _open(batch.column(2).to_pylist(), batch.column(3).to_pylist()), batch.column(4).to_pylist(), strict=True):
                for x in runs:
                    first, last = _unpack(x["pack"])
                    for to, value in zip(out, (u1, u2, first, x["k"], x["runs"], x["whole"], (x["pack"] >> 24) - first, text[first : last + match]), strict=True):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["u1", "u2", "first", "k", "runs", "whole", "reach", "piece"])

    return run


def _piece_windows(pieces: list[bytes], match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, fingerprint) of every window of every piece."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    windows = Windows(data, offsets, match)
    count = sizes - match + 1
    piece = np.repeat(np.arange(len(pieces)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[piece] + within
    return piece, within, windows.hash(start, start + match, 5)


SPAN = "u1 long, u2 long, start long, stop long"


def _spans(u1, u2, starts: np.ndarray, match: int) -> pa.RecordBatch:
    """Windows, sorted by text and start, as spans of bytes; neighbours that start one byte apart are one span."""
    if len(starts):
        new = np.concatenate([[True], (u1[1:] != u1[:-1]) | (u2[1:] != u2[:-1]) | (starts[1:] != starts[:-1] + 1)])
        at = np.flatnonzero(new)
        end = np.concatenate([at[1:], [len(starts)]]) - 1
        u1, u2, starts, stops = u1[at], u2[at], starts[at], starts[end] + match
    else:
        stops = starts
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u1, u2, starts, stops)], ["u1", "u2", "start", "stop"])


def _compare_groups(match: int):
    """Rows come sorted by k. Whole groups are taken together until they have TOGETHER rows."""

    def resolved(rows: pa.Table) -> pa.RecordBatch:
        piece, within, print_ = _piece_windows(rows["piece"].to_pylist(), match)
        k = rows["k"].to_numpy()
        both = print_ ^ (k.view(U64)[piece] * U64(0x9E3779B97F4A7C15))
        _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
        hit = (count[inverse] > 1) & ~rows["whole"].to_numpy(zero_copy_only=False)[piece]
        piece, within = piece[hit], within[hit]
        return _spans(rows["u1"].to_numpy()[piece], rows["u2"].to_numpy()[piece], rows["first"].to_numpy()[piece] + within, match)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                held.append(batch.slice(at, TOGETHER))
                if sum(b.num_rows for b in held) < TOGETHER:
                    continue
                rows = pa.Table.from_batches(held).combine_chunks()
                k = rows["k"].to_numpy()
                begun = int(np.flatnonzero(k == k[-1])[0])  # the last group may go on
                if begun:
                    yield resolved(rows.slice(0, begun).combine_chunks())
                held = rows.slice(begun).combine_chunks().to_batches()
        if held:
            yield resolved(pa.Table.from_batches(held).combine_chunks())

    return run


def _block_rows(match: int, size: int, ratio: int):
    """Blocks of `size` windows, counted from the anchor: what all of a block's windows share, and what they cover together.

    Blocks that the piece has in part cover nothing that another could equal; their outer hash is their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER).to_pydict()
                pieces = part["piece"]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
                rows, blocks, whole = [], [], []
                for i, (text, reach, parents, flag) in enumerate(zip(pieces, part["reach"], part["parents"], part["whole"], strict=True)):
                    low, high = reach - (len(text) - match), reach
                    wanted = [(c, flag) for c in range(low // size, high // size + 1)] if parents is None else [(c, x["whole"]) for x in parents for c in range(x["block"] * ratio, x["block"] * ratio + ratio) if low < (c + 1) * size and c * size <= high]
                    rows += [i] * len(wanted)
                    blocks += [c for c, _ in wanted]
                    whole += [x for _, x in wanted]
                rows, blocks = np.array(rows, np.int64), np.array(blocks, np.int64)
                near, far = blocks * size, blocks * size + size - 1
                reach = np.array(part["reach"], np.int64)[rows]
                lengths = np.diff(offsets)[rows]
                complete = (far <= reach) & (near >= reach - (lengths - match))
                windows = Windows(np.frombuffer(b"".join(pieces), np.uint8), offsets, match)
                anchor = offsets[rows] + reach
                salt = np.array(part["k"], np.int64)[rows].view(U64) * U64(0x9E3779B97F4A7C15) + blocks.astype(U64)
                inner = mix(windows.hash(anchor - near, anchor - far + match, 7) ^ salt)
                first, u1, u2 = (np.array(part[c], np.int64)[rows] for c in ("first", "u1", "u2"))
                outer = mix(windows.hash(np.where(complete, anchor - far, anchor), np.where(complete, anchor - near + match, anchor), 8) ^ salt)
                outer = np.where(complete, outer, mix(mix(mix(u1.view(U64)) ^ u2.view(U64)) ^ (first << 12 | blocks).view(U64)))
                start = first + reach - far
                columns = (inner.view(np.int64), outer.view(np.int64), u1, u2, first, blocks, start, first + reach - near + match)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array(whole, pa.bool_())], ["inner", "outer", "u1", "u2", "first", "block", "start", "stop", "whole"])

    return run


def _compare_blocks(pieces: DataFrame, match: int, tables: Tables) -> DataFrame:
    """Spans in the pieces of large groups, dealt out by content: blocks of 32 windows, then of 4, then single windows.

    A block that covers the same bytes as another repeats as a whole; one whose shared bytes come nowhere else has no
    repeated window; only the others are opened. One of each repeated block goes on, for others to be compared with.
    """
    at = ["u1", "u2", "first"]
    spans, todo = None, pieces.withColumn("parents", F.lit(None).cast("array<struct<block:long,whole:boolean>>"))
    for size, ratio in ((32, 0), (4, 8), (1, 4)):
        rows = tables.keep(todo.select(*at, "k", "reach", "piece", "whole", "parents").mapInArrow(tidied(_block_rows(match, size, ratio)), "inner long, outer long, u1 long, u2 long, first long, block long, start long, stop long, whole boolean"))
        shared = rows.groupBy("inner").agg(F.count("*").alias("n")).where("n > 1").select("inner")
        same = rows.groupBy("outer").agg(F.count("*").alias("n"), F.min(F.struct(*at, "block")).alias("one")).where("n > 1").select("outer", "one")
        marked = rows.join(dealt_anew(same), "outer", "left")
        found = marked.where("one IS NOT NULL AND NOT whole").select("u1", "u2", "start", "stop")
        spans = found if spans is None else spans.union(found)
        if size > 1:
            going_on = marked.where(F.col("one").isNull() | (F.col("one") == F.struct(*at, "block"))).join(dealt_anew(shared), "inner", "left_semi")
            parents = going_on.groupBy(*at).agg(F.collect_set(F.struct("block", (F.col("whole") | F.col("one").isNotNull()).alias("whole"))).alias("parents"))
            todo = pieces.join(parents, at)
    return spans


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans as maximal runs; those that touch are one."""
    runs: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if runs and start <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], stop)
        else:
            runs.append((start, stop))
    return runs


def whole_words(text: bytes, start: int, stop: int) -> int:
    """Words that lie in text[start:stop] with both their ends."""
    inside = text[start:stop]
    cut = lambda at: 0 < at < len(text) and not text[at - 1 : at].isspace() and not text[at : at + 1].isspace()  # noqa: E731  bytes' blanks are the six ASCII ones
    parts = len(inside.split())
    return max(0, parts - cut(start) - cut(stop)) if parts > 1 else int(parts == 1 and not cut(start) and not cut(stop))


def _removed(batches: Iterator[pa.RecordBatch], keep_text: bool, least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        out = [], [], [], []
        for text, spans in zip(_open(batch.column(1).to_pylist(), batch.column(2).to_pylist()), batch.column(3).to_pylist(), strict=True):
            runs = [r for r in _merged(spans or []) if not least_words or whole_words(text, *r) >= least_words]
            kept, at = [], 0
            for start, stop in runs:
                kept.append(text[at:start])
                at = stop
            kept.append(text[at:])
            left = b"".join(kept)
            for to, value in zip(out, (len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if keep_text else None), strict=True):
                to.append(value)
        columns = [batch.column(0), batch.column(2), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        yield pa.RecordBatch.from_arrays(columns if keep_text else columns[:-1], names if keep_text else names[:-1])


def repeated_spans(docs: DataFrame, match: int, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """(u1, u2, start, stop): bytes covered by a string of `match` bytes that also starts elsewhere; spans may overlap."""
    if not 2 * 64 <= match < 4096:
        raise ValueError("match is from 128 to 4095 bytes")
    spark = docs.sparkSession
    tables = tables or Tables(spark)
    send_fewer_texts(spark)
    texts = _texts(docs, id_col, text_col)
    suffixes = tables.keep(texts.select("u1", "u2", "text").mapInArrow(tidied(_suffixes(match)), "u1 long, u2 long, pack long, head long, k long, r long"))
    family = SuffixFamily(spark, tables)
    for i in range(batches):
        family.add(suffixes.where(F.pmod(F.hash("u1", "u2"), F.lit(batches)) == i).select("head", "k"))
    repeated = tables.keep(suffixes.join(dealt_anew(family.matches()), "k", "left_semi").select("u1", "u2", "pack", "k", "r"))
    tables.drop(suffixes)
    runs = tables.keep(repeated.groupBy("k", "r").agg((F.count("*") > 1).alias("whole")))
    of_k = runs.groupBy("k").agg(F.count("*").alias("runs"))
    known = repeated.join(dealt_anew(runs), ["k", "r"]).join(dealt_anew(of_k), "k")
    known = tables.keep(known.select("u1", "u2", "pack", "k", "r", "runs", "whole"))
    tables.drop(repeated)
    anchor, before, after = F.shiftright("pack", 24), F.shiftright("pack", 12).bitwiseAND(0xFFF), F.col("pack").bitwiseAND(0xFFF)
    whole = known.where("whole").select("u1", "u2", (anchor - before).alias("start"), (anchor - after + match).alias("stop"))

    # What must be compared: runs that don't repeat as a whole, and one of each whole run that others share an anchor with.
    one = known.where("whole AND runs > 1").groupBy("k", "r", "runs").agg(F.min(F.struct("u1", "u2", "pack")).alias("x")).select("x.u1", "x.u2", "x.pack", "k", "runs", F.lit(True).alias("whole"))
    open_runs = known.where("NOT whole").select("u1", "u2", "pack", "k", "runs", "whole").union(one)
    by_text = open_runs.groupBy("u1", "u2").agg(F.collect_list(F.struct("pack", "k", "runs", "whole")).alias("found"))
    squeezed = texts.select("u1", "u2", "id", "text").mapInArrow(tidied(_squeezed), f"u1 long, u2 long, id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, squeezed binary")
    once = squeezed.select("u1", "u2", "squeezed", "n_bytes")
    pieces = tables.keep(
        by_text.join(once, ["u1", "u2"]).select("u1", "u2", "squeezed", "n_bytes", "found").mapInArrow(tidied(_pieces(match)), "u1 long, u2 long, first long, k long, runs long, whole boolean, reach long, piece binary")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = pieces.where(F.col("runs") <= GROUP).repartition(n, "k").sortWithinPartitions("k").mapInArrow(tidied(_compare_groups(match)), SPAN)
    large = _compare_blocks(pieces.where(F.col("runs") > GROUP), match, tables)
    return whole.union(small).union(large)


def remove_repeats(docs: DataFrame, match: int = 400, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carried: str | None = None, least_words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text what is left (characters cut in two are dropped).

    With `carried` that column, of any type, stands in the place of doc_id. With least_words only runs that hold as many whole words go.
    """
    tables = Tables(docs.sparkSession)
    spans = repeated_spans(docs, match, batches, id_col, text_col, tables)
    by_text = tables.keep(spans.distinct().groupBy("u1", "u2").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    tables.drop_all_but(by_text)
    out = carried or id_col
    kind = docs.schema[out].dataType
    squeezed = _texts(docs, id_col, text_col, carried).select("u1", "u2", "id", "text").mapInArrow(tidied(_squeezed), T.StructType().add("u1", "long").add("u2", "long").add("id", kind).add("n_bytes", "long").add("squeezed", "binary"))
    joined = squeezed.join(by_text, ["u1", "u2"], "left").select("id", "squeezed", "n_bytes", "spans")
    schema = T.StructType().add("id", kind).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if keep_text:
        schema = schema.add("kept_text", "string")
    return joined.mapInArrow(tidied(lambda batches: _removed(batches, keep_text, least_words)), schema).withColumnRenamed("id", out)


def oracle(match: int = 400) -> str:
    """The same rows in DuckDB's SQL, by counting all windows."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT u, s, hash(b[s:s + {match - 1}]) AS h FROM (SELECT u, b, unnest(range(1, octet_length(b) - {match - 2})) AS s FROM d WHERE octet_length(b) >= {match})),
hit AS (SELECT u, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
run AS (SELECT u, s, sum(new) OVER (PARTITION BY u ORDER BY s) AS k FROM (SELECT u, s, (s - coalesce(lag(s) OVER (PARTITION BY u ORDER BY s), -{match}) > {match})::INTEGER AS new FROM hit)),
span AS (SELECT u, min(s) AS a, max(s) + {match} AS z FROM run GROUP BY u, k),
gap AS (SELECT u, lag(z, 1, 1) OVER (PARTITION BY u ORDER BY a) AS f, a AS t FROM span UNION ALL SELECT u, max(z), NULL FROM span GROUP BY u),
kept AS (SELECT u, string_agg(hex(b[f:coalesce(t - 1, octet_length(b))]), '' ORDER BY f) AS k FROM gap JOIN d USING (u) GROUP BY u),
n AS (SELECT u, sum(z - a) AS removed, count(*) AS spans FROM span GROUP BY u)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(k), b)) AS kept_sha256
FROM d LEFT JOIN n USING (u) LEFT JOIN kept USING (u)
"""
