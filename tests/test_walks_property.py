"""Cell-bucketed walking-pair join = brute force over all pairs."""

import math
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from transitrisk.operators.walks import walk_pairs


def _hav(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (a[1], a[2], b[1], b[2]))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), lat0=st.sampled_from([0.0, 47.37, 69.6, -33.9]))
def test_walk_pairs_match_brute_force(spark, seed, lat0):
    rng = random.Random(seed)
    pts = [(f"s{i}", lat0 + rng.uniform(-0.01, 0.01), 8.5 + rng.uniform(-0.015, 0.015)) for i in range(60)]
    pts.append(("dup", pts[0][1], pts[0][2]))
    df = spark.createDataFrame(pts, "stop string, lat double, lon double")
    got = {(r.dep_node, r.arr_node) for r in walk_pairs(df, 500.0).collect()}
    exp = {(a[0], b[0]) for a in pts for b in pts if a[0] != b[0] and _hav(a, b) <= 500.0}
    assert got == exp
