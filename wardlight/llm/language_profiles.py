"""Language identification by rank-order profiles of character n-grams.

A profile is a language's 300 most frequent 1- to 3-grams of letters (a blank stands for what borders a word), counted
over all training documents. Every language that has a gram is learned, however small its share is; grams are ranked in
Spark, so 300 rows a language reach the driver. A document's own 300 most frequent grams are compared with each profile by out-of-place distance:
the difference of ranks, or 300 for a gram that the profile lacks. The nearest profile wins, ties by name.

score is 1 minus the distance's share of the greatest possible.

Rows: a null text, or one without letters, is `und` with score 0, as is every text where nothing could be learned.
Null languages don't train; a null id counts as fold 0. Repeated rows are predicted alike; an empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, cut, send_fewer_texts, tidied

RANKS = 300
UNKNOWN = "und"
_HELD = 400_000  # distinct grams that a training task holds before it passes them on


_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_codes(text: str | None) -> np.ndarray:
    """Codes of all grams of a text: up to three code points of 21 bits; 0 is a word's border."""
    points = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    points = np.where(letter, points, 0).astype(np.int64)
    pairs = points[:-1] << 21 | points[1:]
    one, two, three = points[letter], pairs[letter[:-1] | letter[1:]], (pairs[:-1] << 21 | points[2:])[letter[1:-1]]
    return np.concatenate([one, two, three])


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.diff(np.concatenate([at, [len(codes)]]))


def top_grams(text: str | None, ranks: int = RANKS) -> np.ndarray:
    """The text's most frequent grams, most frequent first, ties by code."""
    codes, count = _counted(gram_codes(text))
    if len(codes) > ranks:  # only those as frequent as the last that counts need sorting
        least = np.partition(count, len(count) - ranks)[len(count) - ranks]
        codes, count = codes[count >= least], count[count >= least]
    return codes[np.argsort(-count, kind="stable")[:ranks]]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, (codes, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0
        for k, (lang, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
            codes = gram_codes(text.as_py())
            waiting.setdefault(lang.as_py(), []).append(codes)
            size += len(codes)
            if size > 1_000_000 or k + 1 == batch.num_rows:
                for name, parts in waiting.items():
                    codes, n = _counted(np.concatenate(parts))
                    if name in held:
                        both, inverse = np.unique(np.concatenate([held[name][0], codes]), return_inverse=True)
                        codes, n = both, np.bincount(inverse, np.concatenate([held[name][1], n])).astype(np.int64)
                    held[name] = codes, n
                waiting, size = {}, 0
        if sum(len(c) for c, _ in held.values()) > _HELD:
            yield from passed_on()
    yield from passed_on()


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", ranks: int = RANKS) -> list[tuple[str, list[int]]]:
    """(language, grams by rank) of each language, from all given documents."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = cut(rows.mapInArrow(tidied(_gram_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    frequent = counts.withColumn("place", place).where(F.col("place") <= ranks).select("lang", "gram", "n").collect()
    found: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, n in frequent:
        found.setdefault(lang, []).append((-n, gram))
    return [(lang, [g for _, g in sorted(grams)[:ranks]]) for lang, grams in sorted(found.items())]


def predict(docs: DataFrame, profiles: list[tuple[str, list[int]]], id_cols: list[str], text_col: str = "text", ranks: int = RANKS, keep_row: bool = False) -> DataFrame:
    """The id columns (with keep_row all columns), lang_pred and score."""
    send_fewer_texts(docs.sparkSession)
    langs = [lang for lang, _ in profiles]
    # Who has a gram, and at which rank: entries sorted by gram, from bounds[k] to bounds[k + 1] those of the k-th.
    codes = np.array([g for _, p in profiles for g in p], np.int64)
    order = np.argsort(codes, kind="stable")
    grams, first = np.unique(codes[order], return_index=True)
    bounds = np.append(first, len(codes))
    whose = np.array([k for k, (_, p) in enumerate(profiles) for _ in p], np.int64)[order]
    rank = np.array([i for _, p in profiles for i in range(len(p))], np.int64)[order]

    def nearest(text: str | None) -> tuple[str, float]:
        own = top_grams(text, ranks)
        if not len(own) or not langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        known = np.flatnonzero(grams[at] == own)
        begin, n = bounds[at[known]], bounds[at[known] + 1] - bounds[at[known]]
        entry = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        near = ranks - np.abs(rank[entry] - np.repeat(known, n))
        far = ranks * len(own) - np.bincount(whose[entry], near, len(langs))
        k = int(far.argmin())
        return langs[k], 1.0 - float(far[k]) / (ranks * len(own))

    columns = docs.columns if keep_row else id_cols
    names = [f"c{i}" for i in range(len(columns))]
    rows = docs.toDF(*[f"c{i}" for i in range(len(columns))]).withColumn("t", F.col(f"c{docs.columns.index(text_col)}")) if keep_row else docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    schema = rows.drop("t").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(tidied(run), schema)


def identify_languages(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score. Documents of the held-out fold don't train; without a fold all train."""
    if held_out is None:
        held_out = crc_fold(id_col, 3) == 1
    profiles = learn_profiles(docs.where(~held_out), lang_col, text_col)
    marked = docs.select(F.col(id_col).alias("i"), held_out.alias("h"), F.col(text_col).alias("t"))
    out = predict(marked, profiles, ["i", "h"], "t")
    return out.select(F.col("c0").alias(id_col), F.col("c1").alias("held_out"), "lang_pred", "score")


def oracle(folds: int = 3, held_out_fold: int = 1, ranks: int = RANKS) -> str:
    """The same rows in DuckDB's SQL; letters by Unicode property, CRC-32 from its table."""
    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS u, doc_id, lang, lower(' ' || coalesce(text, '') || ' ') AS x,
    coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {folds}, 0) = {held_out_fold} AS held_out FROM documents, tab),
p AS (SELECT u, list_transform(string_split(x, ''), lambda c: CASE WHEN regexp_matches(c, '^\\p{{L}}$') THEN unicode(c)::BIGINT ELSE 0 END) AS p FROM d),
i AS (SELECT u, p, unnest(range(1, len(p) + 1)) AS i FROM p),
g AS (SELECT u, p[i] AS g FROM i WHERE p[i] > 0 UNION ALL SELECT u, (p[i] << 21) | p[i + 1] FROM i WHERE i < len(p) AND (p[i] > 0 OR p[i + 1] > 0)
    UNION ALL SELECT u, (((p[i] << 21) | p[i + 1]) << 21) | p[i + 2] FROM i WHERE i + 1 < len(p) AND p[i + 1] > 0),
n AS (SELECT u, g, count(*) AS n FROM g GROUP BY ALL),
own AS (SELECT u, g, r FROM (SELECT u, g, row_number() OVER (PARTITION BY u ORDER BY n DESC, g) - 1 AS r FROM n) WHERE r < {ranks}),
learned AS (SELECT lang, g, sum(n) AS n FROM n JOIN d USING (u) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
profile AS (SELECT lang, g, r FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS r FROM learned) WHERE r < {ranks}),
near AS (SELECT u, lang, sum({ranks} - abs(own.r - profile.r)) AS near FROM own JOIN profile USING (g) GROUP BY ALL),
size AS (SELECT u, {ranks} * count(*) AS most FROM own GROUP BY u),
far AS (SELECT u, l.lang, most, most - coalesce(near, 0) AS far FROM size CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN near USING (u, lang)),
best AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY u ORDER BY far, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, '{UNKNOWN}') AS lang_pred, coalesce(1.0::DOUBLE - far::DOUBLE / most::DOUBLE, 0.0::DOUBLE) AS score FROM d LEFT JOIN best USING (u)
"""
