"""Random small timetables: DataFrame rounds = exhaustive path enumeration."""

import random

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from tests.bruteforce import Ride, solve
from transitrisk.functions.gamma import gamma_cdf
from transitrisk.operators.delays import cdf_grids
from transitrisk.plans.journeys import Timetable, plan, prepare_rides

LAWS = {"a": (1.0, 0.0, 90.0), "b": (2.5, -30.0, 40.0), "c": (4.0, -60.0, 30.0)}
NODES = ["n0", "n1", "n2", "n3", "n4"]


def _random_rides(seed):
    rng = random.Random(seed)
    rows = []
    eid = 1
    for trip in range(1, 9):
        day = rng.choice([0, 0, 1])
        t = day * 86400 + rng.randrange(8 * 3600, 11 * 3600, 60)
        stop = rng.choice(NODES)
        for _ in range(rng.randint(1, 4)):
            nxt = rng.choice([n for n in NODES if n != stop])
            dur = rng.randrange(120, 1500, 60)
            rows.append((eid, trip, day, stop, nxt, t, t + dur, rng.choice("abc")))
            eid += 1
            t += dur + rng.choice([0, 60, 120])
            stop = nxt
    return rows


def _walks(seed):
    rng = random.Random(seed * 7 + 1)
    w = {}
    for _ in range(rng.randint(0, 4)):
        a, b = rng.sample(NODES, 2)
        w[(a, b)] = w[(b, a)] = rng.randrange(60, 600, 30)
    return w


def _cdf(law, slack):
    a, l, s = LAWS[law]
    return float(gamma_cdf([float(slack)], a, l, s)[0])


@pytest.fixture(scope="module")
def grids(spark):
    d = spark.createDataFrame([(k, *v) for k, v in LAWS.items()],
                              "dist_id string, shape double, loc double, scale double")
    return cdf_grids(d).cache()


@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_rounds_match_bruteforce(spark, grids, seed):
    rows = _random_rides(seed)
    e = spark.createDataFrame(rows, "edge_id long, trip_id long, day_start int, dep_node string, "
                                    "arr_node string, dep_sow int, arr_sow int, dist_id string")
    rides = prepare_rides(e).cache()
    walks = _walks(seed)
    wdf = spark.createDataFrame([(a, b, s) for (a, b), s in walks.items()], "dep_node string, arr_node string, walk_s int")
    tt = Timetable(rides, wdf, grids)
    rl = [Ride(r.edge_id, r.trip_id, r.day_start, r.seg, r.seq, r.path_id, r.dep_node, r.arr_node,
               r.dep_sow, r.arr_sow, r.dist_id) for r in rides.collect()]
    rng = random.Random(seed + 3)
    qs = []
    for qid in range(6):
        a, b = rng.sample(NODES, 2)
        mode = rng.choice(["depart", "arrive"])
        T = rng.randrange(7 * 3600, 12 * 3600, 300) if mode == "depart" else rng.randrange(9 * 3600, 14 * 3600, 300)
        qs.append((qid, mode, a, b, T, rng.choice([0.0, 0.3, 0.6, 0.9])))
    q = spark.createDataFrame(qs, "query_id long, mode string, dep_node string, arr_node string, t_sow int, "
                                  "threshold double")
    summary, _ = plan(q, tt)
    got = {r.query_id: r for r in summary.collect()}
    deps = {r.dep_node for r in rl}
    arrs = {r.arr_node for r in rl}
    for qid, mode, a, b, T, th in qs:
        g = got[qid]
        if a not in deps or b not in arrs:
            assert g.status.startswith("rejected")
            continue
        start, target = (a, b) if mode == "depart" else (b, a)
        exp = solve(rl, walks, _cdf, mode, start, target, T, th)
        if exp is None:
            assert g.status == "no_path", (seed, qid, g)
            continue
        assert g.status == "ok", (seed, qid, g, exp)
        t_exp = T + exp[0] if mode == "depart" else T - exp[0]
        assert (g.arr_sow if mode == "depart" else g.dep_sow) == t_exp, (seed, qid, g, exp)
        assert g.prob == pytest.approx(exp[1], rel=1e-9), (seed, qid, g, exp)
