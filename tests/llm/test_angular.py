"""Hard negatives against scores of all pairs, and the bounds that filter them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import angular

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, tag int, dim string"


def brute(rows, scale=256, k=5, m=5, low=80, high=100):
    sound = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if None not in (i, lab, v) and v and None not in v and all(map(math.isfinite, v))]
    out, seen = [], set()
    for i, lab, v in sound:
        if i % 100 or (i, lab, tuple(v)) in seen:
            continue
        seen.add((i, lab, tuple(v)))
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in sound if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == lab][:k]:
            inside = [s for s in scored if s[2] != lab and low * -p <= 100 * -s[0] <= high * -p][:m]
            out += [(i, j, r, s[1], -p, -s[0]) for r, s in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    table = spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, angular.hard_negatives(table, F.col("vec_id") % 100 == 0, **more).collect()))


def near_centres(rng, n, dim=16, centres=6, spread=0.15):
    middle = rng.normal(size=(centres, dim))
    v = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    return np.float32(v / np.linalg.norm(v, axis=1)[:, None] * rng.uniform(0.5, 2, (n, 1)))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(angular, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(angular, "ROW_BLOCK", 40)


@pytest.mark.parametrize("references", [0, 1, 8])
def test_equals_all_pairs(spark, small_blocks, references):
    rng = np.random.default_rng(1)
    v = near_centres(rng, 700)
    rows = [(10 * i, [float(x) for x in v[i]], int(rng.integers(0, 4))) for i in range(700)]
    got = mined(spark, rows, references=references)
    assert got == brute(rows) and len(got) > 300


def test_odd_tables(spark, small_blocks):
    rnd = random.Random(2)
    some = lambda n=3: [float(np.float32(rnd.uniform(-1, 1))) for _ in range(n)]
    rows = [(i * 50, some(), i % 2) for i in range(40)] + [(i * 100, some(2), 0) for i in range(20, 25)]
    rows += [rows[4], rows[4], (rows[5][0], rows[4][1], 1), (rows[4][0], some(), 1), *[(7000 + i, rows[2][1], i % 2) for i in range(6)]]
    rows += [(None, some(), 1), (100, None, 1), (200, [], 1), (300, [1.0, None, 0.5], 1), (400, [1.0, math.nan, 0.5], 0), (500, [math.inf, 1.0, 1.0], 1), (600, some(), None)]
    rows += [(8000, [0.0, 0.0, 0.0], 1), (8001, [0.0, 0.0, 0.0], 1), (8002, [0.0, 0.0, 0.0], 0), (9000, [0.5], 3)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(100, None, 1)]) == []


def test_large_components(spark, small_blocks):
    rng = np.random.default_rng(3)
    v = near_centres(rng, 60, dim=4) * np.float32(3e5)
    rows = [(20 * i, [float(x) for x in v[i]], i % 3) for i in range(60)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="int too big|too large|Overflow|out of bounds"):
        mined(spark, [(100 * i, [1e18, float(i)], i % 2) for i in range(6)])


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for scale in (1, 256, 1e6):
        v = np.floor(scale * np.concatenate([near_centres(rng, 200, dim=8), -near_centres(rng, 20, dim=8), np.zeros((2, 8))]))
        v[5], v[6] = v[4], -v[4]
        norms = np.sqrt((v**2).sum(axis=1))
        angles = angular.angles_to(v, norms, angular.reference_directions(v[:50]))
        scores = v @ v.T
        low, high = angular.pair_bounds(angles, norms, angles, norms)
        assert (low <= scores).all() and (scores <= high).all()
        for at in range(0, len(v), 37):
            part = slice(at, at + 37)
            low, high = angular.block_bounds(angles, norms, angles[part], norms[part])
            assert (low <= scores[:, part].min(axis=1)).all() and (scores[:, part].max(axis=1) <= high).all()


def test_windows():
    least, most = angular.windows_of([[100, 90, 10], [0], [-5], []], 80, 100)
    assert [list(map(round, x[np.isfinite(x)])) for x in least] == [[8, 72], [0], [], []]
    assert [list(map(round, x[np.isfinite(x)])) for x in most] == [[10, 100], [0], [], []]


def side(v, ids, labels, directions):
    norms = np.sqrt((v**2).sum(axis=1))
    x = {"dim": v.shape[1], "ids": ids.tobytes(), "tags": ids.tobytes(), "labels": labels.tobytes(), "vectors": v.tobytes(), "norms": norms.tobytes(), "angles": angular.angles_to(v, norms, directions).tobytes()}
    return angular.Side(x)


def test_few_pairs_are_scored_near_centres():
    rng = np.random.default_rng(5)
    v = np.floor(256 * near_centres(rng, 3000, dim=32, centres=8, spread=0.03).astype(float))
    ids, labels = np.arange(len(v)), rng.integers(0, 5, len(v))
    directions = angular.reference_directions(v[:500])
    a, b = side(v[:50], ids[:50], labels[:50], directions), side(v, ids, labels, directions)
    best, scored = angular.positives(a, b, 5)
    assert scored < 0.6 * (labels[:50][:, None] == labels[None, :]).sum()
    known = [[int(s) for s in scores] for _, _, scores in sorted(best, key=lambda x: x[0])]
    _, scored = angular.negatives(a, b, known, 99, 100, 5)
    assert scored < 0.4 * len(a.ids) * len(v)
