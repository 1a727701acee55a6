"""Timetable, path, walk and delay operators on hand-made frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitrisk.functions import gamma as G
from transitrisk.operators import delays as D
from transitrisk.operators import paths as PA
from transitrisk.operators import timetable as TT
from transitrisk.operators import walks as WK

OBS_SCHEMA = ("trip_id string, day_start int, week_day int, arr_sod int, dep_sod int, stop string, "
              "arrival_delay bigint, departure_delay bigint")


def test_pairs_wrap_and_midnight(spark):
    rows = [("t", 6, 6, 23 * 3600 + 50 * 60, 23 * 3600 + 51 * 60, "A", 10, 0),
            ("t", 6, 0, 10 * 60, 11 * 60, "B", 20, 0),        # Monday 00:10, same run (started Sunday)
            ("t", 6, 0, 30 * 60, 31 * 60, "C", 30, 0)]
    s = TT.delay_stats(spark.createDataFrame(rows, OBS_SCHEMA))
    p = {(r.dep_node, r.arr_node): r for r in TT.consecutive_pairs(s).collect()}
    ab = p[("A", "B")]
    assert ab.day_offset == 1 and ab.delta == pytest.approx(19.0)
    assert ab.mean_delay == 20  # arrival row's statistics
    ca = p[("C", "A")]  # wrap to the first row one week later
    assert ca.wrap and ca.day_offset == 7 - 1 and ca.mean_delay == 10
    e = TT.valid_edges(TT.consecutive_pairs(s))
    assert {(r.dep_node, r.arr_node) for r in e.collect()} == {("A", "B"), ("B", "C")}


def test_bridge_repair(spark):
    rows = [("t", 0, 0, 100, 100, "A", 1, 0), ("t", 0, 0, 200, 500, "X", 2, 0),
            ("t", 0, 0, 300, 300, "B", 3, 0), ("t", 0, 0, 600, 600, "C", 4, 0)]
    p = TT.consecutive_pairs(TT.delay_stats(spark.createDataFrame(rows, OBS_SCHEMA)))
    assert TT.anomalies(p).count() == 1  # X departs 500 > B arrives 300
    r = TT.valid_edges(TT.bridge_repair(p, "X"))
    got = {(x.dep_node, x.arr_node): x for x in r.collect()}
    assert ("A", "B") in got and got[("A", "B")].arr_sod == 300 and got[("A", "B")].mean_delay == 3
    assert not any(k[0] == "X" for k in got)


def test_paths_across_sunday_night(spark):
    rows = [("r", 6, "A", "B", 6 * 86400 + 86000), ("r", 6, "B", "C", 7 * 86400 + 100),
            ("r", 6, "C", "D", 7 * 86400 + 900)]
    e = spark.createDataFrame(rows, "trip_id string, day_start int, dep_node string, arr_node string, dep_sow int")
    e = e.withColumn("dep_sow", F.pmod("dep_sow", F.lit(604800)))  # Monday legs wrap to small values
    p = PA.run_paths(e).collect()[0]
    assert p.path == ["A", "B", "C", "D"]


def test_walk_pairs_edges_of_the_radius(spark):
    lat0, lon0 = 47.378177, 8.540192
    dlat = lambda m: m / 6371000.0 * 180 / math.pi
    rows = [("o", lat0, lon0), ("n499", lat0 + dlat(499), lon0), ("n501", lat0 - dlat(501), lon0),
            ("twin", lat0, lon0), ("cell", lat0, lon0 + 0.0061)]
    s = spark.createDataFrame(rows, "stop string, lat double, lon double")
    w = {(r.dep_node, r.arr_node): r for r in WK.walk_pairs(s).collect()}
    assert ("o", "n499") in w and ("o", "n501") not in w
    assert w[("o", "twin")].metres == 0 and w[("o", "twin")].walk_s == 0
    assert ("o", "cell") in w and ("cell", "o") in w  # ~461 m, neighbouring grid cells
    assert ("n499", "o") in w


def test_walk_links_know_whether_they_lead_on(spark):
    from transitrisk.operators.transfers import orient_walks
    w = spark.createDataFrame([("a", "b", 100), ("b", "a", 100), ("b", "c", 150), ("c", "b", 150), ("x", "y", 9), ("y", "x", 9)],
                              "dep_node string, arr_node string, walk_s int")
    got = {(r.a, r.b): r.more for r in orient_walks(w, "depart").collect()}
    assert got == {("a", "b"): True, ("b", "a"): False, ("b", "c"): False, ("c", "b"): True, ("x", "y"): False, ("y", "x"): False}


def test_gamma_numerics():
    x = np.array([0.0, 60, 120, 300, -60])
    got = G.gamma_cdf(x, 4.659833415701387, -46.000000000100002, 25.816068623767663)
    assert got == pytest.approx([0.0520899, 0.4558734, 0.8120146, 0.9981528, 0.0], abs=1e-7)
    z = np.array([0.3, 1.7, 6.2])
    for k in (1, 2, 3, 5):
        erl = 1 - np.exp(-z) * sum(z ** i / math.factorial(i) for i in range(k))
        assert G.gamma_cdf(z, float(k), 0.0, 1.0) == pytest.approx(erl, abs=1e-12)


def test_gamma_fit_recovers_parameters(spark):
    rng = np.random.default_rng(0)
    x = rng.gamma(4.66, 25.8, size=20000) - 46.0
    df = spark.createDataFrame([("k", float(v)) for v in x], "key string, delay double")
    fit = D.fit_gamma(D.gamma_stats(df, "key", loc_pad=1.0)).collect()[0]
    assert fit.method == "mle"
    # location fixed at min − pad: the MLE equations hold for shape and scale
    z = x - fit.loc
    s = math.log(z.mean()) - np.log(z).mean()
    assert math.log(fit.shape) - G.digamma(np.array([fit.shape]))[0] == pytest.approx(s, abs=1e-10)
    assert fit.shape * fit.scale == pytest.approx(z.mean(), rel=1e-9)
    # the loc shift biases the shape down but stays in range
    assert 3.5 < fit.shape < 4.8


def test_cdf_lookup_both_paths(spark):
    dists = spark.createDataFrame([("g", 2.0, -10.0, 30.0), ("p", None, 50.0, None)],
                                  "dist_id string, shape double, loc double, scale double")
    grids = D.cdf_grids(dists)
    df = spark.createDataFrame([("g", -20), ("g", 0), ("g", 60), ("g", 100000), ("p", 49), ("p", 50),
                                (None, 5)], "d string, s int")
    a = {(r.d, r.s): r.p for r in D.with_cdf(df, grids, "d", "s").collect()}
    b = {(r.d, r.s): r.p for r in D.with_cdf(df, grids, "d", "s", cells=10 ** 12).collect()}
    assert a == b
    assert a[("g", -20)] == 0.0 and a[("g", 100000)] == 1.0 and a[(None, 5)] == 1.0
    assert a[("p", 49)] == 0.0 and a[("p", 50)] == 1.0
    assert a[("g", 60)] == pytest.approx(float(G.gamma_cdf([60.0], 2.0, -10.0, 30.0)[0]))


def test_percentiles_match_numpy(spark):
    vals = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    df = spark.createDataFrame([("e", v) for v in vals], "edge_id string, delay bigint")
    r = D.delay_percentiles(df, "edge_id").collect()[0]
    for p in D.PERCENTILES:
        assert r[f"p{p}"] == pytest.approx(np.percentile(vals, p))


def test_delay_lists_agree_with_counts(spark):
    rows = [("t", 0, 0, 100, 100, "A", 5, 0), ("t", 0, 0, 100, 100, "A", 7, 0),
            ("t", 0, 0, 100, 100, "A", None, 0), ("t", 0, 0, 200, 200, "B", 1, 0)]
    s = {r.stop: r for r in TT.delay_stats(spark.createDataFrame(rows, OBS_SCHEMA), with_lists=True).collect()}
    assert sorted(s["A"].delays) == [5, 7] and s["A"].num_delays == 2 and s["A"].mean_delay == 6.0
    assert s["B"].delays == [1] and s["B"].std_delay is None
