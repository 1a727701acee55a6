import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitrisk.operators import delays as D
from transitrisk.operators import summaries as SU


def rows(seed=3, n=600):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", "b"]), f"2024-0{rng.randrange(1, 5)}",
             rng.choice([None, rng.randrange(-30, 200), 7])) for _ in range(n)] + [("single", "2024-01", 5), ("none", "2024-02", None)]


def make(spark, data):
    return spark.createDataFrame(data, "stop string, month string, delay int")


def test_periods_merge_to_the_whole(spark, tmp_path):
    data, path = rows(), str(tmp_path / "summary")
    old, new = [r for r in data if r[1] < "2024-04"], [r for r in data if r[1] == "2024-04"]
    SU.write_periods(SU.period_counts(make(spark, old), "stop", "month"), path)
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/period=*/*.parquet")}
    for _ in range(2):  # a repeated load changes nothing
        SU.write_periods(SU.period_counts(make(spark, new), "stop", "month"), path)
    assert all(os.path.getmtime(f) == t for f, t in files.items())  # earlier months untouched
    got = {r["stop"]: r for r in SU.summary_stats(SU.merged_counts(spark, path, "stop"), "stop").collect()}
    assert set(got) == {"hot", "a", "b", "single"}
    for stop, r in got.items():
        x = np.array([d for s, _, d in data if s == stop and d is not None], float)
        assert r["n"] == len(x) and r["mean"] == pytest.approx(x.mean())
        assert r["std"] is None if len(x) == 1 else r["std"] == pytest.approx(x.std(ddof=1))
        assert [r[c] for c in D.FEATURE_COLS] == pytest.approx(list(np.percentile(x, D.PERCENTILES)))


def test_periods_are_pruned(spark, tmp_path):
    path = str(tmp_path / "summary")
    SU.write_periods(SU.period_counts(make(spark, rows()), "stop", "month"), path)
    some = SU.merged_counts(spark, path, "stop", "2024-02", "2024-03")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
    assert some.agg(F.sum("cnt")).first()[0] == sum(m in ("2024-02", "2024-03") and d is not None for _, m, d in rows())


@pytest.mark.parametrize("values", [[], [None], [5], [1, 2], [3] * 50, list(range(101)), [0, 0, 0, 10, None, -4]])
def test_exact_quantiles(spark, values):
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "x int").repartition(3)
    got = {r["prob"]: r["quantile"] for r in SU.exact_quantiles(df, "x", probs).collect()}
    known = [v for v in values if v is not None]
    assert set(got) == set(probs)
    for p in probs:
        assert got[p] is None if not known else got[p] == pytest.approx(np.quantile(known, p))


@pytest.mark.parametrize("pad", [1e-10, 1.0])
def test_ties_at_the_minimum_do_not_make_the_law(spark, pad):
    data = [("ties", 0)] * 10 + [("ties", v) for v in range(1, 40)] + [("same", 4)] * 5 + [("one", 3)]
    counts = D.delay_counts(spark.createDataFrame(data, "stop string, delay int"), "stop")
    fixed = {r["stop"]: r for r in D.fit_gamma(D.stats_from_counts(counts, "stop", F.lit(pad))).collect()}
    got = {r["stop"]: r for r in SU.choose_laws(counts, "stop", pad).collect()}
    assert fixed["ties"]["shape"] < (0.2 if pad < 1e-6 else 1.1)
    assert got["ties"]["shape"] > 0.5 and got["ties"]["ks"] <= got["ties"]["ks_fixed"] and got["ties"]["ks"] < 0.25
    assert got["same"]["method"] == got["one"]["method"] == "point"


def test_a_true_gamma_is_recovered(spark):
    x = np.floor(np.random.default_rng(2).gamma(4.0, 30.0, 4000)).astype(int)
    counts = D.delay_counts(spark.createDataFrame([("g", int(v)) for v in x], "stop string, delay int"), "stop")
    r = SU.choose_laws(counts, "stop").first()
    assert r["ks"] < 0.03 and r["ks"] <= r["ks_fixed"]
    assert r["shape"] * r["scale"] + r["loc"] == pytest.approx(x.mean(), rel=0.05)
