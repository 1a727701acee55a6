"""Hard negatives against every score of every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitrisk.llm import hardnegatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, q string, key1 long"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows):
    fine = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    wide = max((len(v) for *_, v in fine), default=0)
    fine = [(i, lab, v + [0] * (wide - len(v))) for i, lab, v in fine]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (i, lab, v) in enumerate(fine):
        if i is None or i % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for b, (j, other, w) in enumerate(fine) if b != a]
        for p, pid, _ in sorted((s for s in scored if s[2] == lab), key=order)[:5]:
            hard = sorted((s for s in scored if s[2] != lab and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:3]
            out += [(i, pid, r + 1, n, p, s) for r, (s, n, _) in enumerate(hard)]
    return sorted(out, key=str)


def found(spark, rows, **given):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r[c] for c in NAMES) for r in H.mine(table, F.col("vec_id") % 50 == 0, **given).collect()), key=str)


@pytest.mark.parametrize("block_rows", [(2048, 65536), (10, 10)])
def test_against_all_pairs(spark, block_rows):
    rng = random.Random(3)
    rows = [(i * 5, rng.randrange(3), [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    assert found(spark, rows, block_rows=block_rows) == brute(rows)


def test_nulls_ties_copies_and_odd_vectors(spark):
    rng = random.Random(9)
    few = [[float(rng.randrange(-2, 3)) / 8 for _ in range(4)] for _ in range(6)]
    rows = [(i * 10, rng.randrange(3), rng.choice(few)) for i in range(120)]
    rows += [(50, 1, few[0]), (50, 1, few[0]), (None, 2, few[1]), (None, 1, few[0]), (7, None, few[0]), (100, 1, None), (150, 1, [1.0, None]),
             (200, 2, [float("nan"), 1.0]), (250, 0, [float("inf")]), (300, 0, []), (350, 1, [0.5]), (400, 2, [0.0] * 4), (450, 1, [1e30, -1.0])]
    rows = [r for r in rows if r[0] != 450]
    assert found(spark, rows, block_rows=(8, 8)) == brute(rows)


def test_one_copy_group_and_empty(spark):
    rows = [(i, i % 2, [0.25, 0.5]) for i in range(200)] + [(1000 + i, 1, [0.2, 0.4 - i / 100]) for i in range(20)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(50, 1, [1.0])]) == []
    assert found(spark, [(50, 1, [1e38, 1.0]), (51, 1, [-1e38, 1.0]), (52, 2, [1.0, 1.0])]) == []  # held, no crash


def test_reading_stops_early_and_is_exact():
    rng = np.random.default_rng(0)
    rows = rng.integers(-20, 20, (5000, 3))
    rows[17] = [100, -100, 50]
    lists, anchor = H.SortedLists(rows), np.array([3, -2, 0])
    window = H.ScoreWindow(1)
    met = 0
    for new, scores, threshold in lists.read(anchor):
        met += len(new)
        window.add(new, scores, np.arange(5000), np.arange(5000))
        assert (scores == rows[new] @ anchor).all()
        if not window.open(threshold):
            break
    assert list(window.at) == [17] and met < 1000
    seen = np.concatenate([new for new, _, _ in lists.read(np.zeros(3, np.int64))])
    assert sorted(seen) == list(range(5000))
    assert H.limits(7, 50, 95) == (4, 6) and H.limits(-7, 50, 95) == (-3, -7) and H.limits(0, 50, 95) == (0, 0)
