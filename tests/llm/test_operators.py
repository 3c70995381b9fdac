"""Each corpus operator against a plain brute-force version, on small awkward tables."""

import base64
import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import language_profiles, minhash, mixing, quality_gam, quality_rules, queries, suffix_index, topk, toxicity, warc
from wardlight.llm.byte_windows import Windows
from wardlight.llm.components import connected_components
from wardlight.llm.labelled import labelled_sample
from wardlight.llm.piece_codec import PrefixEncoder, encode_documents, read_model
from wardlight.llm.word_shingles import shingle_sets, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join(rng.choice(["the", "Of", "and", "was", "thing", "règle", "alpha", "beta", "gamma", "delta", "x1", "y2", "#tag", "end."]) + str(rng.randint(0, 9)) * rng.randint(0, 1) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(5, 160)) for _ in range(40)]
    texts = [*base, *base[:6], None, "", " \t\n", "word", "two words", "漢字 🙂 mixed\r\nlines\n\nlines", "a " * 3000, sentence(rng, 4000)]
    for t in base[6:20]:  # near copies, and passages inside other texts
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), sentence(rng, 20) + "\n" + t + sentence(rng, 5)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base[0], None, None, None), (None, None, None, None, None), rows[3], rows[3]]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, n_words int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2 if i % 7 else None, i % 3 == 0 and 1 or 0) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_empty_tables(spark, empty, labels):
    none = labels.limit(0)
    for df in (quality_rules.quality_rules(empty), suffix_index.remove_repeats(empty), minhash.near_duplicates(empty), toxicity.toxicity(empty, none), toxicity.toxicity(empty, labels), language_profiles.identify_languages(empty), quality_gam.quality_scores(empty, none), mixing.mix_sources(empty), encode_documents(empty, queries.piece_model_file())):
        assert df.count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_rules_count_and_judge(spark, docs):
    got = {}
    for r in quality_rules.quality_rules(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text, *_ in corpus():
        if doc_id is None:
            continue
        words = WORD.findall(text or "")
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
        for r in got[doc_id]:
            assert tuple(r)[1:6] == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not r.kept or not r.base_failed)
    assert sum(map(len, got.values())) == docs.count()


def test_quality_rules_part_junk_from_prose(spark):
    rng = random.Random(1)
    prose = [" ".join(rng.choice("the of and to house walks slowly in a green river over hills with it".split()) for _ in range(200)) for _ in range(40)]
    junk = ["".join(rng.choice("#*$%&|<>!!") for _ in range(3)) + " ".join(f"{rng.choice('QXZ')}{rng.randint(0, 999)}###" for _ in range(200)) for _ in range(3)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + junk)], "doc_id long, text string, lang string")
    verdicts = {r.doc_id: r.kept for r in quality_rules.quality_rules(df).collect()}
    assert all(verdicts[i] for i in range(40)) and not any(verdicts[i] for i in range(40, 43))
    assert quality_rules.quality_rules(df.withColumn("lang", F.lit(None).cast("string"))).where("kept").count() == 43


@pytest.mark.parametrize("most_sent", [100_000, 0])
def test_quality_rules_keep_rare_languages(spark, monkeypatch, most_sent):
    monkeypatch.setattr(quality_rules, "MOST_SENT", most_sent)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("the of and to house walks slowly in a green river over hills with it".split()) for _ in range(2000)), "en") for i in range(60)]
    rows.append((99, " ".join(rng.choice("talo kulkee hitaasti vihreä joki yli mäkien kanssa leipä vesi kivi pilvi".split()) for _ in range(100)), "fi"))
    rows += [(1000 + i, f"word{i}", f"l{i}") for i in range(250)]  # more languages than the 200 of a literal
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert len(got) == len(rows) and all(got[i].kept for i in range(60))
    assert got[99].kept and got[99].char_distance == got[99].word_distance == 0


def js(p, q):
    total = sum(x * np.log2(2 * x / (x + y)) for x, y in zip(p, q, strict=True) if x) + sum(y * np.log2(2 * y / (x + y)) for x, y in zip(p, q, strict=True) if y)
    return max(0.0, total / 2) ** 0.5


@pytest.mark.parametrize("many", [35_328, 7])
def test_quality_rules_by_hand(spark, monkeypatch, many):
    """Each language has bins of its own; words of several languages, and letters beyond the first plane, are told apart."""
    monkeypatch.setattr(quality_rules, "_MANY", many)
    rng = random.Random(4)
    vocab = {lang: ["Und", "a🙂", *(f"{lang}{k}" for k in range(40))] for lang in ("aa", "bb", "cc", "dd")}
    rows = [(i, " ".join(vocab[lang][min(int(rng.expovariate(0.2)), 41)] for _ in range(rng.choice([5, 90, 150]))), lang) for i in range(60) for lang in [rng.choice([*vocab])]]
    rows += [(100, " ".join(f"new{k}" for k in range(200)), None), (101, "und " * 100, "aa"), (102, "x" * 500, "ee"), (103, "", "ff"), (104, None, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, n_common=9).collect()}
    words = {i: [w.lower() for w in WORD.findall(t or "")] for i, t, _ in rows}
    counted, total = {}, Counter()
    for i, _, lang in rows:
        if lang and words[i]:
            counted.setdefault(lang, Counter()).update(words[i])
            total[lang] += len(words[i])
    own = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:9]] for lang, c in counted.items()}
    shares = lambda c, n, lang: [c[w] / n for w in own[lang]] + [1 - sum(c[w] for w in own[lang]) / n]
    for i, *_ in rows:
        r, c = got[i], Counter(words[i])
        if r.n_words < quality_rules.MIN_WORDS:
            assert r.word_distance is None
            continue
        least = min(js(shares(c, r.n_words, lang), shares(counted[lang], total[lang], lang)) for lang in own)
        if least <= quality_rules.MAX_WORD_DISTANCE:
            assert r.word_distance == pytest.approx(least, abs=1e-6)
        else:
            assert not r.kept


def brute_spans(texts, match):
    seen = Counter(t[i : i + match] for t in texts for i in range(len(t) - match + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - match + 1):
            if seen[t[i : i + match]] > 1:
                mark[i : i + match] = b"\x01" * match
        out.append((len(t), sum(mark), sum(1 for i in range(len(t)) if mark[i] and (not i or not mark[i - 1])), hashlib.sha256(bytes(x for x, m in zip(t, mark, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [256, 1])
@pytest.mark.parametrize("batches", [1, 3, 4])
def test_suffix_dedup(spark, docs, monkeypatch, group, batches):
    monkeypatch.setattr(suffix_index, "GROUP", group)
    rows = corpus()
    want = sorted((r[0], *w) for r, w in zip(rows, brute_spans([(r[1] or "").encode() for r in rows], 130), strict=True) if r[0] is not None)
    got = sorted(tuple(r) for r in suffix_index.remove_repeats(docs, match=130, batches=batches).where("doc_id IS NOT NULL").collect())
    assert got == want and sum(w[2] for w in want) > 1000


def test_suffix_family_levels(spark, monkeypatch):
    """Each batch meets every level, and what these scans find is the result: without one of them it is not complete."""
    batch = lambda *ks: spark.createDataFrame([(k // 3, k) for k in ks], "head long, k long")
    family = suffix_index.SuffixFamily(spark)
    assert family.add(batch(1, 2)).count() == 0
    assert [r.k for r in family.add(batch(2, 3)).collect()] == [2] and sorted(family.levels) == [1]
    assert [r.k for r in family.add(batch(4, 4)).collect()] == [4] and sorted(family.levels) == [0, 1]
    assert sorted(r.k for r in family.add(batch(5, 1, 4)).collect()) == [1, 4] and sorted(family.levels) == [2]
    assert sorted(r.k for r in family.matches().collect()) == [1, 2, 4]
    assert sorted(tuple(r) for r in family.levels[2].collect()) == [(0, 1, 2), (0, 2, 2), (1, 3, 1), (1, 4, 3), (1, 5, 1)]
    for k in (1, 2):
        scan = suffix_index.SuffixFamily.merge_scan
        with monkeypatch.context() as m:
            m.setattr(suffix_index.SuffixFamily, "merge_scan", staticmethod(lambda array, level, k=k, scan=scan: scan(array, level.where(F.col("k") != k))))
            partial = suffix_index.SuffixFamily(spark)
            for ks in ((1, 2), (2, 3), (4, 4), (5, 1, 4)):
                partial.add(batch(*ks))
            assert k not in {r.k for r in partial.matches().collect()}


def test_suffix_order(spark):
    """Anchors' arrays are in the order of their suffixes' first bytes."""
    rng = random.Random(7)
    text = "".join(rng.choice("abcé漢\n z") for _ in range(6000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = suffix_index._texts(df, "doc_id", "text").select("u1", "u2", "text").mapInArrow(suffix_index._suffixes(200), "u1 long, u2 long, pack long, head long, k long, r long").collect()
    data = text.encode()
    assert len(rows) > 50
    assert [data[r["pack"] >> 24 :][:8] for r in sorted(rows, key=lambda r: r["head"])] == sorted(data[r["pack"] >> 24 :][:8] for r in rows)


def test_suffix_dedup_of_long_texts(spark):
    """Texts beyond the step of 256 KB, with passages that repeat at their far ends."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(60_000)) + passage, passage + "é" + " ".join(word() for _ in range(50_000)), "x" + passage[:150], None]
    got = {r.doc_id: r for r in suffix_index.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), match=140, keep_text=True).collect()}
    n = len(passage)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans) for i in range(4)] == [(len((t or "").encode()), x, s) for t, x, s in zip(texts, (n, n, 150, 0), (1, 1, 1, 0), strict=True)]
    assert got[0].kept_text == texts[0][:-n] and got[1].kept_text == texts[1][n:] and got[2].kept_text == "x" and got[3].kept_text == ""


def test_suffix_dedup_is_judged_in_bytes(spark, tmp_path):
    """Passages of over 50 words go from 400 bytes on, not by their words; n_bytes is the input's size either way."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    words = lambda n: " ".join(word() for _ in range(n))
    texts, sizes = [], (310, 399, 400, 401)
    for size in sizes:
        passage = words(80)[:size]
        assert len(passage) == size and len(passage.split()) > 50
        texts += [f"{words(30)} A{passage}B {words(30)}", f"{words(30)} C{passage}D {words(30)}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [(got[i].n_bytes, got[i].n_removed) for i in range(8)] == [(len(t), size if size >= 400 else 0) for t, size in zip(texts, [s for s in sizes for _ in "ab"], strict=True)]


def brute_components(rows, width, percent):
    def shingles(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("outside", [0, 4])
def test_minhash(spark, docs, monkeypatch, width, outside):
    monkeypatch.setattr(minhash, "OUTSIDE", outside)
    rows = [(r[0], r[1]) for r in corpus() if r[0] is not None]
    got = {tuple(r) for r in minhash.near_duplicates(docs.where("doc_id IS NOT NULL"), width=width).collect()}
    assert got == brute_components(list(dict(rows).items()), width, 80)
    with_null = minhash.near_duplicates(docs, width=width)
    assert with_null.count() == docs.count() and {tuple(r) for r in with_null.where("doc_id IS NOT NULL").collect()} == got


@pytest.mark.parametrize("most_sent", [0, 200_000])
def test_minhash_large_buckets(spark, monkeypatch, most_sent):
    """Near copies of one text that are not all near each other: every remainder goes through blocks."""
    monkeypatch.setattr(minhash, "OUTSIDE", 0)
    for name, value in (("BLOCK", 4), ("ASKING", 2), ("HELD", 3), ("MOST_SENT", most_sent)):  # many shares of one group
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(60)] = f"n{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = {tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == brute_components(rows, 2, 80)


def test_minhash_of_long_texts(spark):
    """Texts beyond the step of 256 KB, near each other and not."""
    rng = random.Random(8)
    words = [f"{rng.choice('abcdef')}{i}" for i in range(50_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:45_000])), (3, " ".join(words[:30_000])), (4, " ".join(words[::-1])), (5, None), (6, " ".join(words[:30_000]) + " end")]
    got = {tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == brute_components(rows, 2, 80)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {(x, find(x)) for x in linked}


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_structured_words_differ(spark):
    """Polynomials modulo 2^64 take a long Thue-Morse string for its complement."""
    texts = [thue_morse(n, letters) for n in (1024, 2048, 8192) for letters in ("ab", "ba", "xy")]
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    assert len(set(words(data, np.array([0, len(data)]))[2].tolist())) == len(texts)
    for n in (1024, 2048, 4096):
        both = np.frombuffer((thue_morse(n) + thue_morse(n, "ba")).encode(), np.uint8)
        a, b = Windows(both, np.array([0, n, 2 * n]), 400).hash(np.array([0, n]), np.array([n, 2 * n]), 1)
        assert a != b
    table = spark.createDataFrame(list(enumerate([texts[0], texts[1], texts[0] + " x", texts[1] + " x"])), "doc_id long, text string")
    assert by_id(minhash.near_duplicates(table, width=2)) == [(i, 1, i, True) for i in range(4)]


def test_word_hashes_tell_words_apart():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab\0") for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    data = "\n".join(texts).encode()
    _, _, hashes, _ = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=False)
    assert len(set(hashes.tolist())) == len(set(texts)) and dict(zip(texts, hashes.tolist())) == dict(zip(texts[::-1], hashes.tolist()[::-1]))


def test_shingles_of_no_and_few_words():
    texts = [b"", b" \t", b"One", b"one two", b"ONE two one TWO", b"one two"]
    sets = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 2)
    assert [len(s) for s in sets] == [0, 0, 1, 1, 2, 1] and sets[3].tolist() == sets[5].tolist()


def test_toxicity_learns_words(spark, docs, labels):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = [rng.choice("river house green walks slowly over hills bread water stone".split()) for _ in range(60)]
        if toxic:
            w[rng.randrange(60)] = rng.choice(["nastyfool", "vilescum"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    found = toxicity.toxicity(df, lab).join(lab, "doc_id").where("held_out").collect()
    assert len(found) > 50 and sum(r.predicted == r.toxic for r in found) >= 0.97 * len(found)
    odd = toxicity.toxicity(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()}) == 1


def test_toxicity_by_hand(spark):
    """Counts, ratios and scores of the fitted model, gram by gram; the solver's slope is nought."""
    rng = random.Random(12)
    words = "river house green walks slowly over hills bread WATER stone nasty vile été".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), float(rng.random() < 0.3)) for i in range(60)]
    rows += [(60, None, 0.0), (61, "", 1.0), (62, "ab", 0.0), (63, "nasty " * 60_000, 1.0)]
    sample = spark.createDataFrame([(i, t or "", y) for i, t, y in rows], "doc_id long, text string, y double")
    model = toxicity.fit(sample, features=40, least_docs=3, slot_bits=12)
    slot_of = lambda g: int({n: s for n, s in toxicity._slots(np.frombuffer(g, np.uint8), 12) if n == len(g)}[len(g)][0])
    lower = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    grams = lambda data: {data[k : k + n] for n in toxicity.SIZES for k in range(len(data) - n + 1)}
    found = {i: {slot_of(g) for g in grams(lower(t))} for i, t, _ in rows}
    n1 = sum(y for *_, y in rows)
    n0 = len(rows) - n1
    stats = []
    for s in set().union(*found.values()):
        a, b = (sum(s in found[i] for i, _, y in rows if y == label) for label in (1, 0))
        if a + b >= 3:
            o = (a + b) / len(rows)
            stats.append((-((a / n1 - b / n0) ** 2) / (o * (1 - o) + 1e-6), s, np.log((a + 1) / (n1 + 2)) - np.log((b + 1) / (n0 + 2))))
    best = sorted(stats, key=lambda x: (round(x[0], 12), x[1]))[:40]
    assert sorted(model["slots"].tolist()) == sorted(s for _, s, _ in best)
    weight, ratio = dict(zip(model["slots"].tolist(), model["weights"])), {s: r for _, s, r in best}
    raw = {i: model["base"] + sum(weight[s] for s in found[i] & set(weight)) for i, *_ in rows}
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - 1 / (1 + np.exp(-raw[r.doc_id]))) < 1e-9
    error = {i: 1 / (1 + np.exp(-raw[i])) - y for i, _, y in rows}
    assert abs(sum(error.values())) < 1e-3
    for s, w in weight.items():
        assert abs(ratio[s] * sum(e for i, e in error.items() if s in found[i]) + toxicity.PENALTY * w / ratio[s]) < 1e-3


def test_labelled_twice(spark):
    rows = [(i, f"word{i % 2} here and there {'vile' if i % 2 else 'kind'}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("y", "toxic", "i", "t", "slot", "quality")})
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] * 2 + [(3, 0, 0)], "doc_id long, toxic int, quality int")
    for got in (toxicity.toxicity(df, labels), quality_gam.quality_scores(df, labels)):
        assert got.count() == 40 and all(0 <= r.score <= 1 for r in got.collect())


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, toxic int")
    for most, rows in ((2, 2), (30, 30), (100, 60)):
        sample = labelled_sample(docs, labels, "toxic", F.lit(True), most)
        assert sample.count() == rows and sorted(map(tuple, sample.collect())) == sorted(map(tuple, labelled_sample(docs.repartition(5), labels, "toxic", F.lit(True), most).collect()))


def test_languages(spark, docs):
    got = language_profiles.identify_languages(docs).collect()
    assert len(got) == docs.count()
    texts = {r[0]: r[1] for r in corpus()}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) and 0 <= r.score <= 1
    for text in ("", "abc", "Ab, cd! été 漢字", "x" * 50 + " yz"):
        grams = Counter()
        letters = "".join(c if c.isalpha() else " " for c in f" {text} ".lower())
        for n in (1, 2, 3):
            for i in range(len(letters) - n + 1):
                g = letters[i : i + n]
                if (n == 1 and g != " ") or (n == 2 and g != "  ") or (n == 3 and g[1] != " "):
                    grams[sum((ord(c) if c != " " else 0) << 21 * (n - 1 - k) for k, c in enumerate(g))] += 1
        assert language_profiles.top_grams(text).tolist() == [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:300]]


def test_rare_languages_are_learned(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 400), "en" if i % 2 else "fr") for i in range(400)] + [(900, "Ο ήλιος λάμπει πάνω από τα βουνά και η θάλασσα είναι ήρεμη σήμερα", "el"), (901, "12 !!", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = Counter()
    for _, text, lang in rows:
        size[lang] += len(language_profiles.gram_codes(text))
    assert size["el"] < 0.0005 * sum(size.values())
    profiles = language_profiles.learn_profiles(df)
    assert [lang for lang, _ in profiles] == ["el", "en", "fr"]
    for lang, profile in profiles:
        grams = Counter(g for _, t, x in rows if x == lang for g in language_profiles.gram_codes(t).tolist())
        assert profile == [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:300]]
    for r in language_profiles.predict(df, profiles, ["doc_id", "text"]).collect():
        own = language_profiles.top_grams(r.c1).tolist()
        far = [(sum(abs(p.index(g) - i) if g in p else 300 for i, g in enumerate(own)), lang) for lang, p in profiles]
        assert (r.lang_pred, r.score) == ((min(far)[1], 1.0 - min(far)[0] / (300 * len(own))) if own else ("und", 0.0))
        assert r.c0 != 900 or r.lang_pred == "el"


def test_additive_model(spark, docs, labels):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair tells
    model = quality_gam.AdditiveModel(pairs=3, rounds=30).fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs and ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    got = quality_gam.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def features_by_hand(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    chars, n = max(1, sum(map(len, words))), len(words)
    lines = [x.split() for x in re.split(rb"\n", b"\n".join(b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", x)) for x in data.split(b"\n")).lower())]
    full = [tuple(x) for x in lines if x]
    share = lambda c: sum(b in c for b in data) / chars
    some, n_lines = max(1, n), data.count(b"\n") + 1
    return {
        "log_words": np.log1p(n), "word_length": chars / some if n else 0, "upper": share(bytes(range(65, 91))), "digit": share(b"0123456789"), "stop": share(b".,;:?"), "mark": share(b"#*$%&<>"),
        "other_punct": share(b"\"'()[]{}=+-_/\\@^~`"), "bar": share(b"|"), "bang": share(b"!"), "vowel": share(b"aeiou"), "beyond_ascii": share(bytes(range(192, 256))),
        "line_length": np.log1p(n / n_lines), "log_lines": np.log(n_lines), "distinct_words": len(set(low)) / some, "distinct_pairs": len(set(zip(low, low[1:]))) / max(1, n - 1),
        "repeated_next": sum(a == b for a, b in zip(low, low[1:])) / some, "marked_words": sum(w[-1] in b"#*$%&<>!" for w in words) / some, "short_words": sum(len(w) <= 3 for w in words) / some,
        "longest_word": np.log1p(max(map(len, words), default=0)), "distinct_lines": len(set(full)) / max(1, len(full)) if full else 0,
    }


def test_additive_model_by_hand(spark, docs):
    """Features and scores, text by text and table by table."""
    rows = [(i, t) for i, t, *_ in corpus() if i is not None] + [(900, "Ab! cd\nAb! cd\n\nx|# 12\n"), (901, "word " * 60_000)]
    rng = random.Random(1)
    sample = spark.createDataFrame([(i, t or "", float(rng.random() < 0.5)) for i, t in rows], "doc_id long, text string, y double")
    model = quality_gam.fit(sample)
    scores = {r.doc_id: r.score for r in quality_gam.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        want = features_by_hand(text)
        data = np.frombuffer((text or "").encode(), np.uint8)
        got = dict(zip(quality_gam.FEATURES, quality_gam.text_features(data, np.array([0, len(data)]))[0], strict=True))
        assert got == pytest.approx(want, abs=1e-12), (i, text)
        x = [got[f] for f in quality_gam.FEATURES]
        place = lambda edges, v: sum(e < v for e in edges)
        raw = model.base + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, x, strict=True)) + sum(g[place(model.coarse[a], x[a]), place(model.coarse[b], x[b])] for (a, b), g in zip(model.pairs, model.grids, strict=True))
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-9)


def pages_table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(params=["128m", "150b"])
def ranges(spark, request):
    """Bytes of the ranges that files are read in."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_warc_round_trip(spark, tmp_path, ranges):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:99>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX-Evil: 1", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é漢🙂"), (6, "u", f"before {inner} after {inner}"), (7, "u", inner), (8, "u", "WARC/1.0\r\n"), (9, "u", "\r\n\r\n"), (None, "u", "no id"), (10, "u", "y" * 5000), (11, "u", "a: b\r\n" * 60), (12, "u", "\r\n" * 200), (-5, "u", "é\r\n" * 100)]
    df = pages_table(spark, pages).withColumns({c: F.lit("mine") for c in ("digest", "n", "response", "payload", "file", "at")})
    got = {tuple(r) for r in warc.round_trip(df.coalesce(1)).collect()}
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    last = {h or "": i for i, _, h in pages if i is not None}
    want = {(i, len((h or "").encode()), digest(h or ""), "response" if i is None or last[h or ""] == i else "revisit", None if i is None or last[h or ""] == i else last[h or ""]) for i, _, h in pages}
    assert got == want
    folder = str(tmp_path / "w")
    assert warc.write_archives(df.coalesce(1), folder, least_bytes=5) == len(pages)
    assert {r.page_id: r.record_type for r in warc.read_archives(spark, folder).collect()}[3] == "response"


@pytest.mark.parametrize("place", [0, 1])
def test_warc_long_urls(spark, place, ranges):
    pages = [(1, "http://a/", "one"), (2, "http://b/", "two"), (3, "u", "one")]
    pages.insert(place, (9, "data:," + "x" * 70_000, "nine"))
    got = warc.round_trip(pages_table(spark, pages).coalesce(1)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got) == [(1, 3, "revisit"), (2, 3, "response"), (3, 3, "response"), (9, 4, "response")]


def test_warc_is_of_the_format(spark, tmp_path, monkeypatch):
    """Each file starts with a warcinfo record and has as many pages as it may; revisits carry what the format asks for."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = [(i, f"http://x/{i}", f"text {i % 10}") for i in range(40)] + [(7, "u", "text 7"), (7, "u", "text 7"), (39, "v", "text 9")]
    warc.write_archives(pages_table(spark, pages).repartition(2), str(tmp_path / "w"))
    files = [x.read_bytes() for x in (tmp_path / "w").iterdir() if x.name.startswith("part-") and x.stat().st_size]
    assert len(files) > 4
    kinds = Counter()
    for data in files:
        at = 0
        while at < len(data):
            header, _, _ = data[at:].partition(b"\r\n\r\n")
            first, *lines = header.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            assert first == "WARC/1.0" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields) and (fields["WARC-Type"] == "warcinfo") == (at == 0)
            assert ("WARC-Profile" in fields) == ("WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit")
            kinds[fields["WARC-Type"]] += 1
            at += len(header) + 4 + int(fields["Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
    assert kinds == {"warcinfo": len(files), "response": 11, "revisit": 32}
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert Counter(r.record_type for r in got) == {"response": 11, "revisit": 32} and all(r.payload_bytes == 6 and r.refers_to == 30 + r.page_id % 10 for r in got if r.record_type == "revisit")


@pytest.mark.parametrize("harm", ["cut", "payload", "length"])
def test_warc_broken_archives_fail(spark, tmp_path, harm):
    folder = tmp_path / "w"
    warc.write_archives(pages_table(spark, [(i, "u", f"text number {i}") for i in range(20)]).coalesce(1), str(folder))
    file = next(x for x in folder.iterdir() if x.name.startswith("part-"))
    data = file.read_bytes()
    file.write_bytes(data[:-300] if harm == "cut" else data.replace(b"number 7", b"number 8") if harm == "payload" else data.replace(b"Content-Length: 73", b"Content-Length: 72", 1))
    (folder / f".{file.name}.crc").unlink()
    with pytest.raises(RuntimeError, match="digest" if harm == "payload" else "does not end"):
        warc.read_archives(spark, str(folder)).count()


def test_warc_hostile_lengths(spark, ranges):
    lengths = ["9" * 20, "9" * 5000, str((1 << 63) - 1), str((1 << 63) - 40), "9" * 15, "-5", "٣٤", "0x10", "1 2", "00000000000000000003", ""]
    fakes = [f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:99>\r\nContent-Length: {n}\r\n\r\nhi\r\n\r\n" for n in lengths]
    pages = [(1, "u", "first"), *((10 + i, f"u Content-Length: {lengths[i]}", fake) for i, fake in enumerate(fakes)), *((30 + i, "u", f"a {fake} b {fake}") for i, fake in enumerate(fakes)), (4, "u", "last"), (5, "u", "first")]
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.round_trip(pages_table(spark, pages).coalesce(1)).collect()}
    assert got == {i: (len(h.encode()), "revisit" if i == 1 else "response") for i, _, h in pages}


def test_warc_lost_records_fail(spark, monkeypatch):
    df = spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id long, url string, html string")
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a: read(*a).where("page_id > 1"))
    with pytest.raises(RuntimeError, match="2 records were written and 1 read"):
        warc.round_trip(df)


def test_warc_headers_of_any_bytes():
    def plain(data):
        for m in re.finditer(re.escape(warc.MAGIC), data):
            end = data.find(b"\r\n\r\n", m.start())
            lines = [x.partition(b":") for x in data[m.end() : end].split(b"\r\n")] if end >= 0 else [(b"", b"", b"")]
            own = {k.decode().lower(): v.strip().decode() for k, _, v in lines if k.decode().lower() in warc.FIELDS}
            length = own.get("content-length", "")
            if all(colon for _, colon, _ in lines) and length.isascii() and length.isdecimal() and len(length) <= 15 and "warc-type" in own:
                yield m.start(), own, end + 4

    rng, found = random.Random(3), 0
    pieces = [warc.MAGIC, warc.MAGIC, b"\r\n", b"\r\n", b"\r", b"\n", b"x: ", b"no", b"Content-Length: 5\r\n", b"content-length: 7\r\n", b"Content-Length: 1234567890123456\r\n", b"WARC-Type: response\r\n", b"WARC-Refers-To: 1\r\n", b":"]
    for _ in range(40_000):
        data = b"".join(rng.choices(pieces, k=rng.randint(0, 12)))
        want = list(plain(data))
        assert list(warc._headers(data)) == want
        found += len(want)
    assert found > 100
    laden = b"x: WARC/1.0\r\n" * 300_000 + b"WARC-Type: a\r\nContent-Length: 1\r\n\r\n"  # minutes, if each magic read all lines behind it
    assert sum(1 for _ in warc._headers(laden)) == 300_000


def test_topk(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16)) / 4
    v[50:120] = v[40]  # ties
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    rows += [(300, None), (301, [None] * 16), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (None, [1.0] * 16), (304, []), (320, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = np.floor(np.array([r[1] for r in rows[:300]]) * 64).astype(int)
    want = set()
    for q in range(0, 300, 20):
        best = sorted(((-int(whole[q] @ whole[i]), i) for i in range(300) if i != q))[:7]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect()} == want
    huge = spark.createDataFrame([(0, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [-3e7, 5.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(huge, F.col("vec_id") == 0, k=5).orderBy("rank").collect()] == [(1, (64 * 30_000_000) ** 2 + 64 * 128), (2, -((64 * 30_000_000) ** 2) + 64 * 320)]


def test_topk_takes_fewer_products():
    v = np.random.default_rng(3).normal(size=(10_000, 64))
    v = np.floor(v / np.linalg.norm(v, axis=1)[:, None] * 64).astype(np.int64)
    q = v[::20][:100]
    heads = topk._list_heads(q, v)
    cutoffs = np.array([np.sort(v[np.setdiff1d(heads[i], [20 * i])] @ q[i])[-20] for i in range(len(q))], float)
    taken = topk.multiply_adds(q, v, cutoffs)
    assert taken < 0.95 * len(q) * len(v) * v.shape[1]
    i, j, so_far, _ = topk.sufficient(q.astype(float), v.astype(float), cutoffs)
    assert set(zip(*np.nonzero(q @ v.T >= cutoffs[:, None]))) <= set(zip(i, j))
    assert (topk.resolved(q.astype(float), v.astype(float), i, j, so_far)[0] == (q @ v.T)[i, j]).all()


def test_topk_odd_tables(spark):
    """Repeated ids, columns of clashing names, more wanted than there are, and vectors shorter than there are groups."""
    rows = [(0, [1.0, 0.5], "x"), (0, [0.5, 0.5], "x"), (1, [1.0, 1.0], "x"), (1, [1.0, 1.0], "x"), (2, [-1.0, 0.0], "x"), (40, [1.0], "x"), (41, [2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumns({c: F.lit("mine") for c in ("dim", "rank", "ids", "v", "id", "asks", "query_id", "label")})
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=9).collect())
    of = lambda q: sorted(((-sum(64 * 64 * a * b for a, b in zip(q, v)), i) for i, v, _ in rows if i in (1, 2) and len(v) == len(q)))
    both = sorted(of(rows[0][1]) + of(rows[1][1]))
    assert [(r[0], r[2], r[3]) for r in got if r[0] == 0 and r[1] <= 9] == [(0, i, int(-s)) for s, i in both][:9]
    assert [r for r in got if r[0] == 40] == [(40, 1, 41, 64 * 128)]


@pytest.mark.parametrize("together,shard,left", [(10_000, 4096, 1_000_000), (2, 8, 0), (10_000, 16, 1_000_000)])
def test_mixing(spark, docs, monkeypatch, together, shard, left):
    """Targets by resharing, and what is taken by walking each source's stream and permuted blocks, row by row."""
    monkeypatch.setattr(mixing, "TOGETHER", together)
    monkeypatch.setattr(mixing, "MOST_LEFT", left)
    monkeypatch.setattr(mixing.draw_plan, "__defaults__", (shard,))
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count() and by_id(mixing.mix_sources(docs.repartition(7))) == by_id(mixing.mix_sources(docs.coalesce(1)))
    size = Counter()
    hashed = docs.select("doc_id", "text", "source", F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(17)).alias("h"), F.xxhash64("text").alias("tie")).collect()
    for r in hashed:
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(size.values()), {}, set(order)
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]:
        for s in over:
            target[s] = 2 * size[s]
            free.discard(s)
        left = 1.5 * sum(size.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    want = []
    for k, s in enumerate(order):
        width = max(1, min(mixing.BLOCK, size[s] // mixing.LEAST_BLOCKS))
        blocks = -(-size[s] // width)
        slots = np.arange(min(round(target[s] * blocks / size[s]), 2 * blocks))
        drawn = Counter(mixing._permuted(slots % blocks, slots // blocks, blocks, 17 + 1000 * k).tolist())
        buckets, at = max(1, len(hashed) // mixing.BUCKET), 0
        own = [(r.h % buckets, r.h, repr(r.doc_id), r.tie or 0, r.doc_id, len(WORD.findall(r.text or ""))) for r in hashed if r.source == s]
        for *_, doc_id, n in sorted(own):
            want.append((doc_id, n, size[s], round(target[s], 6), sum(drawn[w // width] for w in range(at, at + n))))
            at += n
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_small_sources_meet_their_targets(spark):
    """Whatever a source's size, what is taken of it is its target, by a word or a twentieth."""
    for sizes in ([1, 10, 70, 200, 5000], [70, 70, 70, 65, 129, 4097]):
        rows = [(100 * k + d, " ".join(["w"] * (n // 3 + (d == 0) * (n % 3))), f"s{k}") for k, n in enumerate(sizes) for d in range(3)]
        table = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = mixing.mix_sources(table).collect()
        for k, n in enumerate(sizes):
            own = [r for r in got if r.doc_id // 100 == k]
            taken, target = sum(r.taken for r in own), own[0].target
            assert abs(taken - target) <= max(1, target / 20), (sizes, k, taken, target)
            assert own[0].source_size == n and all(r.taken <= 2 * r.size for r in own)


def test_mixing_draws(spark):
    """Every source gives its quota, in slots numbered without gaps; shards are full, and their counts vary as draws do."""
    quotas = {0: 5000, 1: 37, 2: 0, 3: 900, 4: 1}
    rows = mixing.draw_plan(spark.createDataFrame(list(quotas.items()), "k long, quota long"), 5, 64).collect()
    for k, n in quotas.items():
        assert sorted(x for r in rows if r.k == k for x in range(r.first, r.first + r.n)) == list(range(n))
    shards = Counter()
    for r in rows:
        shards[r.shard] += r.n
    total = sum(quotas.values())
    assert [shards[i] for i in range(total // 64)] == [total * (i + 1) // (total // 64) - total * i // (total // 64) for i in range(total // 64)]
    own = [sum(r.n for r in rows if r.k == 3 and r.shard == i) for i in range(total // 64)]
    p = 900 / total
    assert 0.4 < np.var(own) / (64 * p * (1 - p)) < 2.0
    assert mixing.draw_plan(spark.createDataFrame([(0, 0)], "k long, quota long"), 5).where("n > 0").count() == 0


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        for epoch in (0, 1):
            assert sorted(mixing._permuted(np.arange(n), np.full(n, epoch), n, 5).tolist()) == list(range(n))


def test_sentencepiece_codec(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_file())
    encoder = PrefixEncoder(read_model(queries.piece_model_file()))
    rng = random.Random(6)
    vocabulary = [lib.id_to_piece(rng.randrange(300, 32000)) for _ in range(500)]
    samples = [r[1] or "" for r in corpus()] + [" " * n + x + " " * m for n in (0, 1, 2, 17, 35) for m in (0, 1, 3) for x in ("", "a", "漢", "\n", "▁", "</s>")]
    samples += ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 8))) for _ in range(1500)] + ["".join(rng.choice("ab  é漢\n▁xthe") for _ in range(30)) for _ in range(1500)]
    for text in samples:
        ids, decoded = encoder.encode(text)
        want = lib.encode(text, add_eos=True)
        assert ids == " ".join(map(str, want)) and decoded == lib.decode(want)
    got = encode_documents(docs, queries.piece_model_file(), keep_ids=True).collect()
    texts = {r[0]: r[1] for r in corpus()}
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            want = lib.encode(texts[r.doc_id] or "", add_eos=True)
            assert r.ids == want and r.n_tokens == len(want) and r.decoded == lib.decode(want)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()


def test_sql_forms(spark, tmp_path):
    """Queries with SQL, on the smallest tables."""
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        columns = sorted(df.columns)
        want = con.sql(sql)
        assert sorted(want.columns) == columns, name
        got = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
        assert got == sorted(map(repr, want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())), name
