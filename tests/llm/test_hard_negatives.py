"""Hard negatives against every anchor and row compared in Python's whole numbers."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from scenequery.llm import hard_negatives
from scenequery.llm.hard_negatives import multiplied, narrowed

COLUMNS = "vec_id long, embedding array<double>, label int, i long, j long, k int, chunk int, block long, rank int, found string"


def brute(rows):
    seen, good = set(), []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = vec_id, tuple(math.floor(256 * x) for x in v), (label + 1) % 10 if vec_id % 7 == 0 else label
        if row not in seen:
            seen.add(row)
            good.append(row)
    out = []
    for a, v, label in good:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, own) for b, w, own in good if b != a)
        for s, b, own in [x for x in scored if x[2] == label][:5]:
            negatives = [(t, n) for t, n, o in scored if o != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, b, i + 1, n, -s, -t) for i, (t, n) in enumerate(negatives)]
    return Counter(out)


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, "x") for r in rows], COLUMNS)


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.5, -1.0, 1.25, rng.gauss(0, 1)]) for _ in range(9)], rng.choice([0, 1, 1, 1, 2, 9])) for i in range(-60, 260)]
    rows += [(50, None, 1), (100, [1.0, None] + [0.0] * 7, 1), (150, [float("nan")] * 9, 1), (3, [float("inf")] * 9, 2), (7, [1.0] * 9, None), (None, [1.0] * 9, 1)]
    rows += rows[60:70] + [(11, [0.25] * 9, 1), (11, [0.25] * 9, 2), (50, [1.0] * 9, 2), (12, [1.0, 1.0], 1), (13, [], 2), (14, [1.0] * 12, 1)]
    rows += [(1000 + i, [1.0] * 9, 1) for i in range(30)] + [(2000 + i, [0.75] * 9, 2) for i in range(30)]
    got = hard_negatives.hard_negatives(made(spark, rows), anchor_block=3, row_block=37, dimensions=2).collect()
    assert Counter(map(tuple, got)) == brute(rows) and len(got) > 20


def test_one_block(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(40)], rng.randrange(4)) for i in range(300)]
    assert Counter(map(tuple, hard_negatives.hard_negatives(made(spark, rows)).collect())) == brute(rows)


def test_large_components(spark):
    """Scores beyond 2**53, where doubles are not exact."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(0, 2.0**19) for _ in range(4)], rng.randrange(2)) for i in range(120)]
    got = hard_negatives.hard_negatives(made(spark, rows), row_block=50).collect()
    assert Counter(map(tuple, got)) == brute(rows) and max(r["positive_score"] for r in got) > 2**53
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.hard_negatives(made(spark, [(50, [1e30], 1), (51, [1.0], 1)])).collect()


def test_empty(spark):
    assert hard_negatives.hard_negatives(made(spark, [(50, [1.0], 1)]).limit(0)).count() == 0
    assert hard_negatives.hard_negatives(made(spark, [(51, [1.0], 1)])).count() == 0
    assert hard_negatives.hard_negatives(made(spark, [(50, [1.0], 1)])).count() == 0


def test_products():
    rng = np.random.default_rng(1)
    for top in (100, 2**31):
        a, b = rng.integers(-top, top, (5, 8)), rng.integers(-top, top, (7, 8)) // 16
        assert (multiplied(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a])).all()
    assert [narrowed(np.array([x]))[0] for x in (-128, 128, 2**20, 2**40)] == ["<i1", "<i2", "<i4", "<i8"]
