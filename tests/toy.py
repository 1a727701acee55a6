"""The toy timetable from FIXTURES.md §4 (all on day 0, Monday)."""

from pyspark.sql import functions as F

from transitrisk.plans.journeys import Timetable, prepare_rides
from transitrisk.operators.delays import cdf_grids

# The toy fixture's delay law.
TOY_SHAPE, TOY_LOC, TOY_SCALE = 4.659833415701387, -46.000000000100002, 25.816068623767663

TOY = [  # trip, dep, arr, dep hh:mm, arr hh:mm
    ("1", "node1", "node2", "10:05", "10:15"),
    ("1", "node2", "node4", "10:16", "10:25"),
    ("1", "node4", "node5", "10:26", "10:40"),
    ("21", "node1", "node2", "10:03", "10:13"),
    ("22", "node2", "node4", "10:14", "10:23"),
    ("23", "node4", "node5", "10:24", "10:38"),
    ("3", "node1", "node3", "10:10", "10:15"),
    ("3", "node3", "node5", "10:16", "10:41"),
    ("4", "node3", "node4", "10:19", "10:22"),
]


def hm(s):
    h, m = s.split(":")
    return int(h) * 3600 + int(m) * 60


def toy_timetable(spark, walks=None):
    rows = [(i + 1, int(t), 0, d, a, hm(dt), hm(at), "g") for i, (t, d, a, dt, at) in enumerate(TOY)]
    e = spark.createDataFrame(rows, "edge_id long, trip_id long, day_start int, dep_node string, "
                                    "arr_node string, dep_sow int, arr_sow int, dist_id string")
    rides = prepare_rides(e).cache()
    dists = spark.createDataFrame([("g", TOY_SHAPE, TOY_LOC, TOY_SCALE)],
                                  "dist_id string, shape double, loc double, scale double")
    grids = cdf_grids(dists).cache()
    if walks is None:
        walks = spark.createDataFrame([], "dep_node string, arr_node string, walk_s int")
    return Timetable(rides, walks, grids)
