"""Transfers to rides that are safe: one per group is joined, and a task makes a bounded number of pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tests.growth import most_rows, plain_plans
from tests.test_seed_growth import RIDES
from transitrisk.operators import transfers
from transitrisk.operators.delays import cdf_grids
from transitrisk.plans.journeys import Timetable, _virtual_labels

ASKED = "query_id long, T int, start string, target string, threshold double, bound int"


def grids(spark):
    return cdf_grids(spark.createDataFrame([("g", 1.0, 0.0, 30.0), ("slow", 1.0, 0.0, 2000.0)], "dist_id string, shape double, loc double, scale double"))


def timetable(spark, rows):
    rides = spark.createDataFrame([(i, i, 0, 0, 1, p, a, b, d, r, g) for i, (p, a, b, d, r, g) in enumerate(rows)], RIDES)
    return Timetable(rides, spark.createDataFrame([], "dep_node string, arr_node string, walk_s int"), grids(spark))


@pytest.mark.parametrize("mode", ["depart", "arrive"])
def test_rides_of_an_hour_are_not_all_joined_to_a_label(spark, mode):
    # of the rides of an hour one is the best for every label: the last to leave arrives with all others
    tt = timetable(spark, [(1, "A", "B", 36000 + 10 * i, 40000, "g") if mode == "depart" else (1, "A", "B", 35000 - i, 36000 + 10 * i, "g") for i in range(300)])
    use = tt.prepared(mode, transfers.SearchParams())
    q = spark.createDataFrame([(i, 35999 if mode == "depart" else 39599, "A" if mode == "depart" else "B", "Z", 0.5, 86400) for i in range(100)], ASKED)
    with plain_plans(spark):
        out = transfers.expand(_virtual_labels(q), use.rides, use.links, tt.grids, mode, transfers.SearchParams(), use.cells, use.tables, use.look)
        assert most_rows(out) < 5000  # 30,000 before
    assert out.count() == 100


def test_table_keeps_the_pairs_up_to_the_first_safe_arrival(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(120):
        dep = rnd.choice([rnd.randrange(604800), 36000 + rnd.randrange(3000), 604800 - rnd.randrange(3000)])
        rows.append((rnd.choice([1, 2, 3]), rnd.choice("ABC"), rnd.choice("ABC"), dep, dep + rnd.choice([0, 60, 9000, 50000, 90000]),
                     rnd.choice(["g", "g", "slow", None, "unknown"])))
    tt = timetable(spark, rows)
    walks = spark.createDataFrame([("A", "B", 200, "A"), ("B", "A", 200, "B"), ("C", "B", 4000, "C")],
                                  "dep_node string, arr_node string, walk_s int, prev_node string")
    table = lambda cutoff: [tuple(r) for r in transfers.transfer_table(tt.rides, walks, tt.grids, cutoff=cutoff).collect()]
    groups, arr = {}, {i: r for i, r in enumerate(rows)}
    for x, e, via, walk, gap, slack, p in table(False):
        groups.setdefault((x, via, arr[e][2], arr[e][0]), []).append((gap + arr[e][4] - arr[e][3], gap, e, (x, e, via, walk, gap, slack, p)))
    want = []
    for g in groups.values():
        for *_, row in sorted(g, key=lambda t: t[:3]):
            want.append(row)
            if row[6] is not None and row[6] > 0.99:
                break
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(table(True), key=key) == sorted(want, key=key) and len(want) > 300


def test_pairs_are_the_same_in_slices_and_spread(spark, monkeypatch):
    rows = [(i % 4, "ABC"[i % 3], "BCA"[i % 3], 36000 + 7 * i, 36300 + 7 * i, "g") for i in range(200)]
    tt = timetable(spark, rows)
    law = tt.grids.where("dist_id = 'g'")  # small enough to be broadcast, so the pairs stay where they are made
    one = transfers.transfer_table(tt.rides, None, law, cutoff=False)
    monkeypatch.setattr(transfers, "PAIRS_PER_TASK", 100)
    cut = transfers.transfer_table(tt.rides, None, law, cutoff=False)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, one.collect())) and one.count() > 500
    with plain_plans(spark):
        made = transfers.transfer_table(tt.rides, None, law, cutoff=False).groupBy(F.spark_partition_id()).count()
        assert made.count() > 4 and made.agg(F.max("count")).first()[0] < one.count() / 3
