import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitrisk.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * left / w > 2 * sizes[s]]
        if not over:
            out |= {s: weight[s] * left / w for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            free.remove(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, None: 500, "é": 50, "Z": 7}, {"a": 5}, {"a": 0, "b": 9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_both_totals(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(0, 5000, 400)
    size[:20] = size[0]
    size = -np.sort(-size)
    p = np.full(400, 0.37)
    out = mixing.flight(size, p, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3
    left = size[(out > 0) & (out < 1)].max(initial=1)
    landed = mixing.land(size, out, rng)
    assert set(landed) <= {0.0, 1.0}
    assert abs((landed * size).sum() - (p * size).sum()) <= left


@pytest.mark.parametrize("seed", range(8))
def test_landing_is_small_beside_the_median(seed):
    rng = np.random.default_rng(seed)
    size = -np.sort(-np.exp(rng.normal(5, 1.5, 500)).astype(int))
    p = np.full(500, 0.37)
    landed = mixing.land(size, mixing.flight(size, p, rng), rng)
    assert abs((landed * size).sum() - (p * size).sum()) <= np.median(size) / 2
    assert abs(landed.sum() - p.sum()) <= 2


@pytest.mark.parametrize("seed", range(8))
def test_one_document_outweighs_the_others(seed):
    size = np.array([7000] + [300 - i for i in range(50)])
    p = np.full(51, 0.286)
    landed = mixing.land(size, mixing.flight(size, p, np.random.default_rng(seed)), np.random.default_rng(seed + 99))
    assert set(landed) <= {0.0, 1.0}
    assert abs((landed * size).sum() - (p * size).sum()) <= 300


@pytest.mark.parametrize("size", [[], [5], [0, 0, 0], [7, 7, 7, 7], [5, 1, 1], [0, 0, 9], [10**8, 10**8 - 1, 3, 2, 1]])
def test_flight_of_ties_and_few_units(size):
    size = np.array(size, np.int64)
    p = np.full(len(size), 0.5)
    out = mixing.flight(size, p, np.random.default_rng(1))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3 * max(1, size.max(initial=0) / 1e4)
    assert set(mixing.land(size, out, np.random.default_rng(2))) <= {0.0, 1.0}


def test_inclusion_probabilities_are_kept():
    size = np.array([9, 7, 5, 3, 2, 1])
    total = np.zeros(6)
    for seed in range(4000):
        rng = np.random.default_rng(seed)
        total += mixing.land(size, mixing.flight(size, np.full(6, 0.4), rng), rng)
    assert np.abs(total / 4000 - 0.4).max() < 0.04


def corpus(rng):
    rows = [(i, "w " * rng.choice([1, 5, 80, 300]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    return rows + [(1000, None, "a"), (1001, "", "b"), (None, "x y z", "c"), (1002, "x y", "d"), (1002, "x y", "d")]


def make(spark, rows):
    return spark.createDataFrame([(*r, "en", 1, 2, 3) for r in rows],
                                 "doc_id long, text string, source string, lang string, n_rows int, copies int, key1 int")


def test_mix_meets_targets_and_repeats(spark):
    rows = corpus(random.Random(4))
    want, sizes = [], {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = brute_targets(sizes)

    def run(parts):
        return sorted(map(tuple, mixing.per_row(mixing.mix(make(spark, rows).repartition(parts))).select(
            "doc_id", "source", "size", "source_size", "target", "copies").collect()), key=str)
    got = run(3)
    assert got == run(7)
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == sorted(
        ((i, s, len((t or "").split())) for i, t, s in rows), key=str)
    assert max(r[5] for r in got) <= 2
    for s, total in sizes.items():
        taken = sum(r[2] * r[5] for r in got if r[1] == s)
        assert abs(taken - targets[s]) <= 80, (s, taken, targets[s])
        assert all(r[3] == total and abs(r[4] - targets[s]) < 1e-6 for r in got if r[1] == s)


def test_blocks_and_levels(spark):
    units = spark.range(1000).select(F.lit("s").alias("source"), F.col("id").alias("key1"), F.xxhash64("id").alias("key2"),
                                     (F.col("id") % 40).alias("size"), F.lit(0.3).alias("p"))
    got = mixing.cube_sample(units, block_docs=50).join(units.drop("p"), ["key1", "key2"]).collect()
    assert len(got) == 1000 and {r["p"] for r in got} == {0.0, 1.0}
    assert abs(sum(r["p"] * r["size"] for r in got) - 0.3 * sum(i % 40 for i in range(1000))) <= 40
    assert abs(sum(r["p"] for r in got) - 300) <= 2


def test_materialize(spark):
    docs = make(spark, corpus(random.Random(5)))
    mixed = mixing.mix(docs).cache()
    out = mixing.materialize(docs, mixed)
    assert out.columns == docs.columns
    got = {tuple(r)[:2]: r["n"] for r in out.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {(r["doc_id"], r["source"]): r["copies"] for r in mixed.collect() if r["copies"]}
    assert got == want


def test_empty(spark):
    assert mixing.per_row(mixing.mix(make(spark, []))).count() == 0
