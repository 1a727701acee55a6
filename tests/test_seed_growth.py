"""First rides: the same rows as by looking at every ride, without making them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.growth import most_rows, plain_plans
from transitrisk.operators.transfers import horizon_rides, orient_rides, seed_rides
from transitrisk.plans.journeys import direction_flags

RIDES = ("edge_id long, trip_id long, day_start int, seg int, seq int, path_id long, dep_node string, arr_node string, "
         "dep_sow int, arr_sow int, dist_id string")
ASKED = "query_id long, T long, start string, target string, threshold double"


def oriented(spark, rows, mode="depart"):
    return orient_rides(spark.createDataFrame([(i, i, 0, 0, 1, p, a, b, d, r, "g") for i, (p, a, b, d, r) in enumerate(rows)], RIDES), mode)


@pytest.mark.parametrize("mode", ["depart", "arrive"])
def test_first_rides_are_those_of_the_whole_horizon(spark, mode):
    rnd = random.Random(5)
    rows = []
    for _ in range(400):
        # few seconds around midnights and the week's end, long rides and ties
        dep = rnd.choice([rnd.randrange(604800), rnd.choice([0, 1, 2, 5, 6]) * 86400 + rnd.randrange(-3, 4)]) % 604800
        rows.append((rnd.choice([1, 2, None]), rnd.choice("AB"), rnd.choice("ABC"), dep, dep + rnd.choice([0, 60, 9000, 50000, 86400, 90000])))
    sr = oriented(spark, rows, mode)
    asked = [(rnd.choice([i, i, 7, None]), rnd.choice([rnd.randrange(604800), rnd.randrange(8) * 86400 + rnd.randrange(-3, 4), rows[i][3]]),
              rnd.choice("ABC"), "C", 0.5) for i in range(60)]
    q = spark.createDataFrame(asked, ASKED)
    w = Window.partitionBy("query_id", "to_node", "path_id").orderBy("to_t", "from_t", "edge_id")
    whole = horizon_rides(q, sr, mode).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    got = seed_rides(q, sr, mode)
    assert got.columns == whole.columns
    cols = ["query_id", "to_node", "path_id", "edge_id", "from_t", "to_t"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(cols).collect()), key=key) == sorted(map(tuple, whole.select(cols).collect()), key=key)


def test_rides_of_a_group_are_not_multiplied_by_queries(spark):
    sr = oriented(spark, [(1, "A", "B", 36000 + i, 36600 + i) for i in range(600)])
    q = spark.createDataFrame([(i, 36000 + i, "A", "B", 0.5) for i in range(600)], ASKED)
    with plain_plans(spark):
        assert most_rows(seed_rides(q, sr, "depart")) < 5000  # 179,700 pairs before


def test_flags_do_not_shuffle_the_edges_for_a_few_stops(spark):
    stops = spark.createDataFrame([("A", 8.0, 47.0), ("B", 8.1, 47.0)], "stop string, lon double, lat double").groupBy("stop").agg(
        F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    df = spark.range(10).select(F.lit("A").alias("f"), F.lit("B").alias("t"), F.lit("B").alias("g"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for stops of unknown size
    with plain_plans(spark):
        flags = direction_flags(df, stops, "f", "t", "g")
        assert "SortMergeJoin" not in flags._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r.nice for r in flags.collect()] == [True] * 10
