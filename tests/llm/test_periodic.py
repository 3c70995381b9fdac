"""Periodic runs against a search of every stretch, and their digests against plain sums."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from test_operators import corpus, docs, empty  # noqa: F401

from wardlight.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least_words, least_powers):
    """Every maximal stretch of each period, without those that have a smaller one."""
    n, found = len(words), {}
    for q in range(1, n // least_powers + 1):
        at = 0
        while at < n - q:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if length >= max(least_words, least_powers * q):
                found.setdefault((at, length), q)
            at = end
    return sorted((start, length, q) for (start, length), q in found.items())


def brute_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def repetitive(rng):
    words, letters = [], "abcdefg"[: rng.randint(1, 7)]
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 6, 7, 12, 18, 19, 23]))]
        n = rng.randint(1, 6) * len(unit) + rng.randint(0, len(unit))
        words += (unit * 7)[:n]
        words += [rng.choice(letters) for _ in range(rng.randint(0, 4))]
    return words


@pytest.mark.parametrize("least_words,least_powers", [(6, 4), (1, 3), (40, 3), (10, 6)])
def test_runs_equal_brute_force(least_words, least_powers):
    rng = random.Random(least_words)
    texts = [repetitive(rng) for _ in range(400)] + [list("a" * 500), list("ab" * 250), [], ["x"], list("aab" * 4 + "aab" * 3), (list("abcde" * 3) + ["f"]) * 9]
    codes = np.array([ord(c) for t in texts for c in t], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    wanted = [(d, *r) for d, t in enumerate(texts) for r in brute_runs(t, least_words, least_powers)]
    assert periodic.runs_of(codes, bounds, least_words, least_powers) == wanted
    assert len(wanted) > 50


def test_bands_cover_every_lag():
    for least_words, least_powers in ((6, 4), (1, 3), (300, 3), (17, 9)):
        lags = []
        for first, last, k in periodic.bands(5000, least_words, least_powers):
            lags += range(first, last + 1)
            assert k == min(periodic.overlap(q, least_words, least_powers) for q in range(first, last + 1)) >= last
        assert lags == list(range(1, len(lags) + 1)) and least_powers * (len(lags) + 1) > 5000


def test_seeds_grow_no_faster_than_words():
    """One word a hundred thousand times: as many seeds as words a band, and one extension."""
    codes = np.zeros(100_000, np.int64)
    grams = periodic.Grams(codes, codes)
    for first, last, k in periodic.bands(len(codes), 6, 4):
        grams.lengthened(k)
        assert len(grams.next_occurrences(first, last)[0]) <= len(codes)
    assert periodic.runs_of(codes, np.array([0, len(codes)]), 6, 4) == [(0, 0, 100_000, 1)]


def test_long_texts():
    rng = np.random.default_rng(3)
    unit = rng.integers(0, 50, 4000)
    codes = np.concatenate([rng.integers(0, 50, 3000), np.tile(unit, 5), rng.integers(50, 60, 2000), np.tile(unit[:900], 7)[:6000]])
    got = [r for r in periodic.runs_of(codes, np.array([0, len(codes)]), 6, 4) if r[3] > 100]
    starts = {r[3]: r for r in got}
    assert starts[4000][2] >= 20_000 and starts[900][2] >= 6000 and len(got) == 2


def planted(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_rows(spark, docs, empty):  # noqa: F811
    rows = [(i, t) for i, t, *_ in corpus()] + [(i, "one two three four " * 3 + "five\nsix " * (i % 9)) for i in range(200, 260)]
    table = spark.createDataFrame([(i, t, "clash", 1, 2, 3) for i, t in rows], "doc_id long, text string, runs string, start int, period int, words int").repartition(3)
    got = periodic.run_digests(periodic.find_runs(periodic.with_planted_runs(table)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    wanted = []
    for i, t in rows:
        words = planted(i, t)
        runs = brute_runs(words, 6, 4)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        wanted.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(brute_collapsed(words, runs))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)
    assert sum(w[1] for w in wanted) > 20
    assert periodic.run_digests(periodic.find_runs(periodic.with_planted_runs(empty))).count() == 0


def test_runs_and_texts(spark, docs, empty):  # noqa: F811
    got = periodic.find_runs(docs, least_words=4, least_powers=3).collect()
    wanted = sorted(((i, len(w), brute_runs(w, 4, 3), brute_collapsed(w, brute_runs(w, 4, 3))) for i, t, *_ in corpus() for w in [WORD.findall(t or "")]), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=repr) == wanted
    assert periodic.find_runs(empty).count() == 0
    with pytest.raises(ValueError, match="three periods"):
        periodic.find_runs(docs, least_powers=2)
