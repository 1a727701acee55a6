"""Rows that plans shuffle do not grow with the pairs they make."""

import random

from pyspark.sql import functions as F

from tests.growth import plain_plans
from tests.test_seed_growth import ASKED, oriented
from tests.test_transfer_growth import timetable
from transitrisk.operators import transfers
from transitrisk.operators.transfers import seed_rides
from transitrisk.plans.journeys import direction_flags


def counted(df, name, kind=""):
    """Runs the query; the sum of a metric over its plan's nodes of a kind."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    rows, todo = 0, [qe.executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get(name)
        rows += metric.get().value() if metric.isDefined() and kind in node.nodeName() else 0
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def shuffled_rows(df):
    return counted(df, "shuffleRecordsWritten")


def joined_rows(df):
    return counted(df, "numOutputRows", "Join")


def first_rides(spark):
    """150 queries at a stop with 150 groups of one ride."""
    sr = oriented(spark, [(i, "A", "B", 36000 + i, 36600 + i) for i in range(150)])
    return seed_rides(spark.createDataFrame([(i, 30000 + i, "A", "B", 0.5) for i in range(150)], ASKED), sr, "depart")


def test_first_rides_are_not_shuffled_for_every_query(spark):
    with plain_plans(spark):
        assert shuffled_rows(first_rides(spark)) < 3000  # 46,350 before
    assert first_rides(spark).count() == 22500


def test_flags_of_first_rides_are_not_shuffled_for_every_query(spark):
    stops = spark.createDataFrame([("A", 8.0, 47.0), ("B", 8.1, 47.0)], "stop string, lon double, lat double")
    flags = direction_flags(first_rides(spark), stops, "from_node", "to_node", "target")
    with plain_plans(spark):
        assert shuffled_rows(flags) < 3000
    assert [tuple(r) for r in flags.groupBy("nice").agg(F.count(F.lit(1))).collect()] == [(True, 22500)]


def table_rows(spark, rows, cutoff, walks=None):
    tt = timetable(spark, rows)
    return [tuple(r) for r in transfers.transfer_table(tt.rides, walks, tt.grids, cutoff=cutoff).collect()]


def test_pairs_up_to_the_first_safe_arrival_are_found_without_comparing_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    rows = []
    for _ in range(260):
        # few seconds around half-days and the week's end, and a dense hour; rides overtake each other
        dep = rnd.choice([rnd.randrange(604800), 36000 + rnd.randrange(3000), rnd.randrange(15) * 43200 + rnd.randrange(-4, 5), 42000 + 60 * rnd.randrange(60)]) % 604800
        rows.append((rnd.choice([1, 2, 3]), rnd.choice("ABC"), rnd.choice("ABC"), dep, dep + rnd.choice([0, 1, 60, 600, 3000, 9000, 10799]),
                     rnd.choice(["g", "g", "slow", None, "unknown"])))
    walks = spark.createDataFrame([("A", "B", 200, "A"), ("B", "A", 200, "B"), ("C", "B", 4000, "C")],
                                  "dep_node string, arr_node string, walk_s int, prev_node string")
    groups = {}
    for x, e, via, walk, gap, slack, p in table_rows(spark, rows, False, walks):
        groups.setdefault((x, via, rows[e][2], rows[e][0]), []).append((gap + rows[e][4] - rows[e][3], gap, e, (x, e, via, walk, gap, slack, p)))
    want = []
    for g in groups.values():
        for *_, row in sorted(g, key=lambda t: t[:3]):
            want.append(row)
            if row[6] is not None and row[6] > 0.99:
                break
    key = lambda r: tuple((v is None, v) for v in r)
    compared = transfers._up_to_cutoff
    odd = []
    monkeypatch.setattr(transfers, "_up_to_cutoff", lambda v, *rest: odd.append({r.x_dist for r in v.select(F.col("_last").alias("x_dist")).collect()}) or compared(v, *rest))
    assert sorted(table_rows(spark, rows, True, walks), key=key) == sorted(want, key=key) and len(want) > 1000
    assert odd == [{None, 1.0}]  # only rides without a law or of an unknown one are compared


def test_the_pairs_of_a_cut_table_are_not_shuffled(spark):
    rows = [(i, "A", "B", 30000 + i, 30060 + i, "g") for i in range(60)] + [(100 + i, "B", "C", 36000 + i, 36060 + i, "g") for i in range(60)]
    tt = timetable(spark, rows)
    law = tt.grids.where("dist_id = 'g'")
    with plain_plans(spark):
        table = transfers.transfer_table(tt.rides, None, law)
        assert shuffled_rows(table) < 2500
    assert table.count() == 3600


def pairs_of_a_day(spark):
    """3600 pairs of rides and rides that leave within a day of them."""
    rows = [(i, "A", "B", 30000 + i, 30060 + i, "g") for i in range(60)] + [(100 + i, "B", "C", 36000 + i, 36060 + i, "g") for i in range(60)]
    tt = timetable(spark, rows)
    walks = spark.createDataFrame([("B", "B", 60, "X")], "dep_node string, arr_node string, walk_s int, prev_node string")
    return lambda walk: transfers.transfer_table(tt.rides, walks if walk else None, tt.grids.where("dist_id = 'g'"), direct=not walk, cutoff=False)


def test_rides_are_not_shuffled_for_every_hour_of_a_day(spark):
    table = pairs_of_a_day(spark)
    with plain_plans(spark):
        assert shuffled_rows(table(False)) < 1500
    assert table(False).count() == 3600


def test_a_pair_is_joined_to_its_probability_once(spark):
    table = pairs_of_a_day(spark)
    with plain_plans(spark):
        assert joined_rows(table(True)) < 8000  # a pair made, bounds and points looked up before
    assert table(True).count() == 3600
