"""Periodic runs: stretches of words that repeat with a period, found by seeds and extended along diagonals.

A run is a stretch whose words equal those `period` places on (its smallest period), of `least_words` words and
`least_powers` periods or more, that no neighbouring word extends. So on the diagonal of lag q at least
max(least_words - q, (least_powers - 1) * q) words in a row match: the overlap that is guaranteed.

Method. Lags are taken in bands. A band's seeds are k-grams, k the least overlap that its lags guarantee; a band ends where
a lag would be longer than k. Occurrences of equal k-grams in one document are enumerated next to next only: inside a
run of period q <= k the next occurrence is exactly q words on (were it nearer, both distances would be periods of a
stretch as long as their sum, so their common divisor would be one too, and q not the smallest). So no band has more
pairs than words, however often a phrase comes, there are log(words) bands, and none of the pairs is left out. A pair
is extended along its diagonal both ways; a table of the furthest word covered at each lag lets those be passed over that lie
on a diagonal already extended.

Grams are named exactly, by pairs of names of shorter ones, never by hashes; whatever occurs once in its document leaves
the index before the next length. Documents are independent: one narrow pass, no shuffle, no size at which it changes.

Rows: null and empty texts have no words, no runs and collapse to ''. Repeated rows repeat; an empty table gives an
empty table. Memory is that of a text's words (some 60 bytes each). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, send_fewer_texts, slices, tidied

RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def overlap(lag: int, least_words: int, least_powers: int) -> int:
    """Words in a row that match on the diagonal of any run of this period."""
    return max(least_words - lag, (least_powers - 1) * lag)


def bands(longest: int, least_words: int, least_powers: int) -> Iterator[tuple[int, int, int]]:
    """(first lag, last lag, k) of the bands that documents of up to `longest` words can have runs in."""
    first = 1
    while max(least_words, least_powers * first) <= longest:
        last, k = first, overlap(first, least_words, least_powers)
        while min(k, more := overlap(last + 1, least_words, least_powers)) >= last + 1:
            last, k = last + 1, min(k, more)
            if more > k and k >= last:  # overlaps only rise from here on, so k stays
                last = k
        yield first, last, k
        first = last + 1


class Grams:
    """Exact names of the grams of one length that come twice or more in their document."""

    def __init__(self, codes: np.ndarray, document: np.ndarray):
        self.length, self.total = 1, len(codes)
        self._named(np.arange(len(codes)), document << 32 | codes)

    def _named(self, places: np.ndarray, keys: np.ndarray) -> None:
        """Keeps places whose key comes twice, by key and place; a key stands for one gram of one document."""
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        alone = fresh & np.concatenate([fresh[1:], [True]]) if len(keys) else fresh
        self.places, self.names = places[order][~alone], (np.cumsum(fresh) - 1)[~alone]

    def lengthened(self, to: int) -> None:
        """Joins grams until they have `to` words, by pairs that overlap if need be."""
        while self.length < to and len(self.places):
            step = min(self.length, to - self.length)
            names = np.full(self.total + step, -1)
            names[self.places] = self.names
            both = names[self.places + step] >= 0
            places = self.places[both]
            self._named(places, self.names[both] << 32 | names[places + step])
            self.length += step

    def next_occurrences(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, lag) of pairs of occurrences next to each other, of lags in the band; by lag and place."""
        lag = np.diff(self.places)
        near = (self.names[1:] == self.names[:-1]) & (lag >= first) & (lag <= last)
        places, lag = self.places[:-1][near], lag[near]
        order = np.lexsort((places, lag))
        return places[order], lag[order]


def _matching(x: np.ndarray, y: np.ndarray, backwards: bool = False) -> int:
    """How many of the first (or last) entries are equal; looked at in parts that double."""
    n, done, part = len(x), 0, 64
    while done < n:
        to = min(n, done + part)
        own = slice(n - to, n - done) if backwards else slice(done, to)
        differ = np.flatnonzero(x[own] != y[own])
        if len(differ):
            return n - (n - to + int(differ[-1])) - 1 if backwards else done + int(differ[0])
        done, part = to, 2 * part
    return n


def runs_of(codes: np.ndarray, bounds: np.ndarray, least_words: int, least_powers: int) -> list[tuple[int, int, int, int]]:
    """(document, start in it, length, period) of all runs of documents codes[bounds[d]:bounds[d + 1]], in order."""
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    grams, found = Grams(codes, document), []
    for first, last, k in bands(int(np.diff(bounds).max(initial=0)), least_words, least_powers):
        grams.lengthened(k)
        if not len(grams.places):
            break
        places, lags = grams.next_occurrences(first, last)
        if not len(places):
            continue
        follows = np.concatenate([[False], (places[1:] == places[:-1] + 1) & (lags[1:] == lags[:-1]) & (document[places[1:]] == document[places[:-1]])])
        covered: dict[int, int] = {}
        for at, lag in zip(places[~follows].tolist(), lags[~follows].tolist(), strict=True):
            if at < covered.get(lag, 0):
                continue
            d = document[at]
            low, high = int(bounds[d]), int(bounds[d + 1]) - lag
            end = at + _matching(codes[at:high], codes[at + lag : high + lag])
            start = at - _matching(codes[low:at], codes[low + lag : at + lag], backwards=True)
            covered[lag] = end
            if end - start + lag >= max(least_words, least_powers * lag):
                found.append((int(d), start - low, end - start + lag, lag))
    return sorted(found, key=lambda x: (x[0], x[1], x[3]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one blank, without those that a run (start, length, period) repeats."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6, least_powers: int = 4) -> DataFrame:
    """id, n_words, runs (start, length and period in words, by start, then period) and the collapsed text of each row.

    least_powers is 3 or more: below that, no length of seeds is guaranteed for a range of periods.
    """
    if least_powers < 3 or least_words < 1:
        raise ValueError("runs have three periods or more, and a word")
    send_fewer_texts(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 200):
                # The blanks of bytes.split are the six ASCII ones.
                texts = [(x.as_py() or "").encode().split() for x in part.column(1)]
                bounds, codes = np.concatenate([[0], np.cumsum([len(x) for x in texts])]), []
                for words in texts:
                    known: dict[bytes, int] = {}
                    codes += [known.setdefault(w, len(known)) for w in words]
                runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for d, *own in runs_of(np.array(codes, np.int64), bounds, least_words, least_powers):
                    runs[d].append(tuple(own))
                kept = pa.array([collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
                columns = [part.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], pa.list_(_RUN)), kept]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"`{id_col}` {id_type}, n_words long, runs array<{RUN}>, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text), where texts of ids whose crc32 (of the id as text) 10 divides repeat a stretch of themselves up to their end.

    With g = crc32 div 10 and n words: from word a = g mod n on, the first 1 + (n - a) div (3 + g mod 8) words repeat.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    parted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.when(h % 10 == 0, F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).alias("words"), h.alias("h"))
    sized = parted.select("id", "text", "words", F.floor(F.col("h") / 10).alias("g"), F.size("words").cast("long").alias("n"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p, left = F.col("a").cast("int"), F.col("p").cast("int"), (F.col("n") - F.col("a")).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil(left / p).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(repeated, F.lit(1), left)), " ")
    return placed.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias(text_col))


def _steepest(runs: Column) -> Column:
    """The run of most periods, compared as fractions; of equals the first."""
    rest = F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0)))
    better = lambda best, x: F.when(x.length * best.period > best.length * x.period, x).otherwise(best)
    return F.when(F.size(runs) > 0, F.aggregate(rest, F.get(runs, F.lit(0)), better))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What find_runs says as numbers of the steepest run and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period")))
    every = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    told = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), _steepest(F.col("runs")).alias("best"), F.sha2(every.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return told.select(id_col, "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def oracle() -> str:
    """The same rows in DuckDB's SQL: islands of five-word matches at each lag, the smallest lag of each stretch; CRC-32 from its table."""
    return """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM documents, tab),
e AS (SELECT *, len(ws)::BIGINT AS n, h // 10 AS g, h % 10 = 0 AND len(ws) > 0 AS planted FROM d),
f AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
w AS (SELECT u, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM p),
s AS (SELECT u, i, ws[i + 1 : i + 5] AS k FROM (SELECT u, ws, unnest(range(0, n - 4)) AS i FROM w)),
m AS (SELECT x.u, y.i - x.i AS q, x.i FROM s x JOIN s y ON x.u = y.u AND x.k = y.k AND x.i < y.i),
j AS (SELECT *, i - row_number() OVER (PARTITION BY u, q ORDER BY i) AS island FROM m),
o AS (SELECT u, q, min(i) AS start, max(i) + 5 + q - min(i) AS length FROM j GROUP BY u, q, island),
r AS (SELECT u, start, length, min(q) AS period FROM o WHERE length >= greatest(6, 4 * q) GROUP BY u, start, length),
t AS (SELECT u, count(*)::BIGINT AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY u),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY u ORDER BY length::DECIMAL(38, 18) / period::DECIMAL(38, 18) DESC, start, period) = 1),
gone AS (SELECT DISTINCT u, unnest(range(start + period, start + length)) AS i FROM r),
left_ AS (SELECT u, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT u, unnest(ws) AS x, unnest(range(n)) AS i FROM w) ANTI JOIN gone USING (u, i) GROUP BY u)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN t USING (u) LEFT JOIN b USING (u) LEFT JOIN left_ USING (u)
"""
