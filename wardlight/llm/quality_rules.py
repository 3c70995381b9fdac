"""Quality rules: base counts, then how far a text's histograms lie from those of the languages. Native only.

A reference is, per language, the summed character-class histogram of all documents that carry that language, and the
histogram of its own common words: the COMMON most frequent ones, lower-cased, of all its documents, a bin each, and one bin
for the rest. A document is kept if its base counts pass and if, for some one language, both its Jensen-Shannon
distances (base 2, from 0 to 1) are within the limits. Histograms of too little text are not compared (minimum-length
guards), so short texts face the base counts alone.

The cost is in proportion to a document's words and to the languages it meets, not to all of them: a word finds its bin by a hash
table, a bin the languages that list it. A language none of whose common words a document has is as far from it as from
any such document, so that distance is made once; only if it is within the limit is the language compared with all.

Two passes over the texts: words are counted, and COMMON rows a language reach the driver; then counts go to the checkpoint
folder (some hundred bytes a document), references are summed from there, and the verdict is computed from the same rows.
Every language that has words becomes a reference, however small its share is; all of them are one row (about 1 KB a
language), broadcast behind a count (`MOST_SENT`). Without any reference no document is judged too far.

Rows: a null or blank text has no words and fails the base; a null language feeds no reference; rows with equal
ids are judged one by one; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

BLANKS = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"

#: Most frequent words of a language that get a bin each.
COMMON = 25
#: Bins stand as letters while a text's words are counted: the first so many from one code point on, the others from another.
_FIRST, _MANY, _NEXT, _MOST = 0x4E00, 0xD800 - 0x4E00, 0x10000, 0x110000 - 0x10000

#: Character classes of what is not blank, each with the pattern that counts it; the last bin is the rest.
CHAR_CLASSES = {
    "vowel": "[aeiou]",
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "stop": "[.,;:!?]",
    "symbol": "[#*$%&|<>]",
    "other_ascii": "[\\x00-\\x1F\"'()+\\-/=@\\[\\\\\\]^_`{}~\\x7F]",
    "beyond_ascii": "[^\\x00-\\x7F]",
}

MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.34
MIN_CHARS = 400
MIN_WORDS = 80
#: Languages whose references are sent to all tasks at most.
MOST_SENT = 100_000


def _repeat_words(words: str, windows: str) -> tuple[Column, Column]:
    """Window hashes of five words, and those with their places, sorted, where any hash comes twice."""
    n = F.size(words)
    hashes = F.when(n >= 5, F.expr(f"transform(slice({words}, 1, size({words}) - 4), (w, i) -> xxhash64(w, get({words}, i + 1), get({words}, i + 2), get({words}, i + 3), get({words}, i + 4)))"))
    placed = F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.expr(f"array_sort(transform({windows}, (h, i) -> struct(h, i)))"))
    return hashes, placed


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS + "+"))


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", most: int = COMMON) -> DataFrame:
    """(lang, word): the most frequent words of each language; of equally frequent ones the first by code points."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    words = docs.select(lang.alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.explode(_words(F.lower("text"))).alias("word"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("place", place).where(F.col("place") <= most).select("lang", "word")


def _letter(bin_: int) -> str:
    return chr(_FIRST + bin_ if bin_ < _MANY else _NEXT + bin_ - _MANY)


class Bins:
    """The common words of all languages, a bin each, and a hash table that finds a word's bin without looking through them."""

    def __init__(self, common: DataFrame):
        found = common.select("word").distinct().select("word", F.xxhash64("word").alias("h")).orderBy("word").collect()
        if len(found) > _MANY + _MOST:
            raise ValueError(f"{len(found)} common words of all languages together; {_MANY + _MOST} can be told apart, so take fewer of each")
        self.words = [r["word"] for r in found]
        n = max(1, len(found))
        table: list[list[int]] = [[] for _ in range(n)]
        for k, r in enumerate(found):
            table[r["h"] % n].append(k)
        # Each table is one text in the plan, however many words there are; Spark makes an array of it once.
        literal = lambda x: F.from_json(F.lit(json.dumps(x, ensure_ascii=False)), "array<array<string>>")
        self._n, self._held, self._letters = n, literal([[self.words[k] for k in x] for x in table]), literal([[_letter(k) for k in x] for x in table])

    def letter(self, word: Column) -> Column:
        """The letter of a word's bin, NULL if it has none."""
        at = F.pmod(F.xxhash64(word), F.lit(self._n)).cast("int")
        return F.get(F.get(self._letters, at), F.array_position(F.get(self._held, at), word).cast("int") - 1)


def _bin(letter: str) -> str:
    """A letter's bin, in SQL."""
    return f"if(ascii({letter}) < {_NEXT}, ascii({letter}) - {_FIRST}, ascii({letter}) - {_NEXT - _MANY})"


#: Bin and count of an entry h of a histogram, in SQL.
_BIN_OF, _COUNT_OF = "int(shiftright(h, 32))", "(h & 4294967295L)"


def text_counts(docs: DataFrame, bins: Bins, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Base counts and both histograms of each document, in one narrow pass without Python; of words the bins that it has, bin and
    count in one long."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    out = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.withColumn("words", _words(F.col("text")))
    out = out.withColumn("lines", F.expr(f"filter(split(text, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    out = out.select("doc_id", "lang", "words", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))

    hashes, placed = _repeat_words("words", "windows")
    out = out.withColumns({
        "solid": F.array_join("words", ""),
        "windows": hashes,
        # Each common word becomes a letter; sorted, the letters of a bin are a run, which is counted by its length.
        "code": F.array_join(F.sort_array(F.array_compact(F.transform("words", lambda w: bins.letter(F.lower(w))))), ""),
    })
    out = out.select("doc_id", "lang", F.size("words").cast("long").alias("n_words"), "n_dup_lines", "solid", F.regexp_extract_all("code", F.lit("(?s)(.)\\1*"), F.lit(0)).alias("runs"), placed.alias("placed"))
    twice = F.expr("transform(filter(placed, (x, i) -> (i > 0 AND get(placed, i - 1).h = x.h) OR get(placed, i + 1).h <=> x.h), x -> x.i)")
    classes = [F.regexp_count("solid", F.lit(p)).cast("int") for p in CHAR_CLASSES.values()]
    out = out.select(
        "doc_id", "lang", "n_words", "n_dup_lines",
        F.length("solid").cast("long").alias("word_chars"),
        F.array(*classes).alias("classes"),
        F.expr(f"transform(runs, r -> shiftleft(bigint({_bin('r')}), 32) + length(r))").alias("word_hist"),
        F.sort_array(twice).alias("twice"),
    )
    covered = F.expr("aggregate(zip_with(twice, slice(twice, 2, greatest(size(twice), 1)), (a, b) -> least(5, coalesce(b - a, 5))), 0L, (s, x) -> s + x)")
    return out.select(
        "doc_id", "lang", "n_words", "word_chars",
        F.col("classes")[list(CHAR_CLASSES).index("symbol")].cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.concat(F.col("classes"), F.array(F.expr("int(word_chars) - aggregate(classes, 0, (s, x) -> s + x)"))).alias("char_hist"),
        "word_hist",
    )


def language_references(counts: DataFrame, common: DataFrame, bins: Bins) -> DataFrame:
    """(l, chars, rest, own): a number for each language that has words, shares of its classes and of its rest, and (bin, share) of its own words."""
    known = counts.where("lang IS NOT NULL")
    sums = known.groupBy("lang").agg(*[F.sum(F.col("char_hist")[i]).alias(f"c{i}") for i in range(len(CHAR_CLASSES) + 1)], F.sum("n_words").alias("n_words"))
    letter = F.expr(_bin("letter")).alias("bin")
    listed = common.withColumn("letter", bins.letter(F.col("word"))).select("lang", letter)
    held = known.select("lang", F.explode("word_hist").alias("h")).select("lang", F.expr(f"{_BIN_OF} AS bin"), F.expr(f"{_COUNT_OF} AS n")).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    own = held.join(listed, ["lang", "bin"]).groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("own"), F.sum("n").alias("n_own"))
    numbered = sums.where("n_words > 0").join(own, "lang", "left").withColumn("l", F.row_number().over(W.orderBy("lang")) - 1)
    chars = F.array(*[f"c{i}" for i in range(len(CHAR_CLASSES) + 1)])
    rows = cut(numbered.select("l", "n_words", chars.alias("c"), F.coalesce("n_own", F.lit(0)).alias("n_own"), F.coalesce("own", F.array()).alias("own")))
    return rows.select(
        "l",
        F.expr("transform(c, x -> x / greatest(aggregate(c, 0L, (s, y) -> s + y), 1L))").alias("chars"),
        ((F.col("n_words") - F.col("n_own")) / F.col("n_words")).alias("rest"),
        F.expr("transform(own, x -> struct(x.bin AS bin, x.n / n_words AS q))").alias("own"),
    )


def _part(p: str, q: str) -> str:
    """What a bin adds to twice the squared distance, less the reference's share, so that bins that only the reference has add nothing."""
    term = lambda x: f"if({x} > 0, {x} * log2(2 * {x} / ({p} + {q})), 0D)"
    return f"({term(p)} + {term(q)} - {q})"


def _root(total: str) -> str:
    return f"sqrt(greatest(0D, ({total} + 1) / 2))"


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    n_common: int = COMMON,
) -> DataFrame:
    """doc_id, base counts, base_failed, kept, and the least distances to the languages it was compared with.

    Distances are null where the text is too short, or where there is no such language.
    """
    common = cut(common_words(docs, text_col, lang_col, n_common))
    bins = Bins(common)
    counts = cut(text_counts(docs, bins, id_col, text_col, lang_col))
    refs = cut(language_references(counts, common, bins))
    few = refs.count() <= MOST_SENT
    # For each bin the languages that list it: what a document's words are held against.
    lists = refs.select("l", F.inline("own")).groupBy("bin").agg(F.collect_list(F.struct("l", "q")).alias("of")).agg(F.sort_array(F.collect_list(F.struct("bin", "of"))).alias("lists"))
    alone = F.expr(f"{_root(_part('1D', 'rest'))} <= {max_word_distance}D")  # distance of a document without any of its words
    of_lang = refs.agg(F.sort_array(F.collect_list(F.struct("l", "chars", "rest"))).alias("refs"), F.sort_array(F.collect_list(F.when(alone, F.col("l")))).alias("always"))
    whole = of_lang.crossJoin(lists)

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = counts.withColumns({
        "base_failed": failed,
        "char_share": F.when(F.col("word_chars") >= min_chars, F.expr("transform(char_hist, x -> x / word_chars)")),
        "enough": F.col("n_words") >= min_words,
    }).crossJoin(F.broadcast(whole) if few else whole)
    # Every bin is some language's, so the list of a bin stands at its number.
    met = "flatten(transform(word_hist, h -> transform(get(lists, " + _BIN_OF + ").of, x -> struct(x.l AS l, " + _COUNT_OF + " / n_words AS p, x.q AS q))))"
    out = out.withColumn("met", F.when(F.col("enough"), F.expr(met)))
    out = out.withColumn("asked", F.expr("if(enough, array_union(array_distinct(met.l), always), refs.l)"))
    chars = f"{_root('aggregate(zip_with(char_share, get(refs, l).chars, (p, q) -> ' + _part('p', 'q') + '), 0D, (s, x) -> s + x)')}"
    words = f"aggregate(filter(met, x -> x.l = l), named_struct('s', 0D, 'p', 0D), (a, x) -> named_struct('s', a.s + {_part('x.p', 'x.q')}, 'p', a.p + x.p), a -> {_root('a.s + ' + _part('greatest(0D, 1D - a.p)', 'get(refs, l).rest'))})"
    out = out.withColumn("far", F.expr(f"transform(asked, l -> struct({chars} AS c, {words} AS w))")).withColumn("none", F.size("refs") == 0).drop("refs", "lists", "always", "met", "asked")
    near = F.col("none") | F.expr(f"exists(far, d -> coalesce(d.c, 0D) <= {max_char_distance}D AND coalesce(d.w, 0D) <= {max_word_distance}D)")
    return out.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & near).alias("kept"), F.expr("array_min(far.c)").alias("char_distance"), F.expr("array_min(far.w)").alias("word_distance"),
    )


def oracle() -> str:
    """The same rows in DuckDB's SQL."""
    chars = [*CHAR_CLASSES, "rest"]
    char_counts = ",\n".join(f"len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}')) AS {k}" for k, p in CHAR_CLASSES.items())
    return f"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
base AS (SELECT doc_id, lang, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(ls) - len(list_distinct(ls)) AS n_dup_lines, ws FROM docs),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM base WHERE len(ws) >= 5)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM hit) GROUP BY doc_id),
cls AS (SELECT doc_id, {char_counts} FROM (SELECT doc_id, array_to_string(ws, '') AS t FROM base)),
chist AS (SELECT doc_id, k, v FROM (SELECT doc_id, unnest([{', '.join(repr(c) for c in chars)}]) AS k,
    unnest([{', '.join(CHAR_CLASSES)}, word_chars - ({' + '.join(CHAR_CLASSES)})]) AS v FROM cls JOIN base USING (doc_id))),
lows AS (SELECT doc_id, lang, lower(unnest(ws)) AS w FROM base),
bins AS (SELECT lang AS ref, w FROM (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS r FROM lows WHERE lang IS NOT NULL GROUP BY lang, w) WHERE r <= {COMMON}),
share AS (SELECT lang, sum(n_words) AS n FROM base WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) > 0),
-- Each language has bins of its own: a document's words by the bins of each, and what is in none of them.
common AS (SELECT doc_id, ref, w AS k, count(*) AS v FROM lows JOIN bins USING (w) GROUP BY ALL),
whist AS (SELECT doc_id, ref, k, v FROM common UNION ALL SELECT base.doc_id, share.lang, '', n_words - coalesce(c, 0) FROM base JOIN share ON true LEFT JOIN (SELECT doc_id, ref, sum(v) AS c FROM common GROUP BY ALL) s ON s.doc_id = base.doc_id AND s.ref = share.lang),
hist AS (SELECT 'c' AS h, doc_id, lang AS ref, k, v FROM chist JOIN share ON true UNION ALL SELECT 'w', * FROM whist),
refs AS (SELECT h, ref AS lang, k, sum(v) AS v FROM hist JOIN base USING (doc_id) WHERE lang = ref GROUP BY ALL),
q AS (SELECT h, lang, k, v / greatest(sum(v) OVER (PARTITION BY h, lang), 1) AS q FROM refs),
p AS (SELECT h, doc_id, ref AS lang, k, v / CASE h WHEN 'c' THEN word_chars ELSE n_words END AS p FROM hist JOIN base USING (doc_id)
    WHERE CASE h WHEN 'c' THEN word_chars >= {MIN_CHARS} ELSE n_words >= {MIN_WORDS} END),
-- Bins that only the reference has add q, so the sum starts from all of the reference's shares.
d AS (SELECT p.h, doc_id, lang, sqrt(greatest(0, (sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) - q ELSE 0 END) + 1) / 2)) AS d
    FROM (SELECT p.h, p.doc_id, p.lang, p.p, coalesce(q.q, 0) AS q FROM p LEFT JOIN q ON q.h = p.h AND q.k = p.k AND q.lang = p.lang) p GROUP BY ALL),
ok AS (SELECT doc_id, bool_or(coalesce(c.d, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(w.d, 0) <= {MAX_WORD_DISTANCE}) AS near
    FROM (SELECT doc_id, share.lang FROM base JOIN share ON true) x LEFT JOIN (SELECT * FROM d WHERE h = 'c') c USING (doc_id, lang) LEFT JOIN (SELECT * FROM d WHERE h = 'w') w USING (doc_id, lang) GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, f AS base_failed, NOT f AND coalesce(near, true) AS kept
FROM (SELECT *, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS f FROM base LEFT JOIN rep USING (doc_id)) LEFT JOIN ok USING (doc_id)
"""
