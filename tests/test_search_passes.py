"""Passes of a search: in a dense timetable a query makes few labels, with the same answers."""

import pytest
from pyspark.sql import functions as F

from tests.test_transfer_growth import grids
from transitrisk.functions.timeops import DAY_S, WEEK_S
from transitrisk.operators import transfers
from transitrisk.plans import isochrones as iso
from transitrisk.plans import journeys
from transitrisk.plans.journeys import Timetable, plan

EVERY_S = 240


@pytest.fixture(scope="module")
def dense(spark):
    """A ride from A to B and one back every four minutes of the week, each a path of its own."""
    at = F.col("id") * EVERY_S
    rides = spark.range(WEEK_S // EVERY_S).withColumn("back", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (2 * F.col("id") + F.col("back")).alias("edge_id"), (2 * F.col("id") + F.col("back")).alias("trip_id"),
        F.floor(at / DAY_S).cast("int").alias("day_start"), F.lit(0).alias("seg"), F.lit(1).alias("seq"),
        (2 * F.col("id") + F.col("back")).alias("path_id"),
        F.when(F.col("back") == 0, "A").otherwise("B").alias("dep_node"), F.when(F.col("back") == 0, "B").otherwise("A").alias("arr_node"),
        at.cast("int").alias("dep_sow"), (at + 300).cast("int").alias("arr_sow"), F.lit("g").alias("dist_id")).cache()
    return Timetable(rides, spark.createDataFrame([], "dep_node string, arr_node string, walk_s int"), grids(spark))


@pytest.fixture
def labels_made(monkeypatch):
    made, write = [0], journeys.write_counted

    def counted(df, name):
        out = write(df, name)
        made[0] += out[1] * (name == "search-round")
        return out
    monkeypatch.setattr(journeys, "write_counted", counted)
    return made


@pytest.mark.parametrize("mode", ["depart", "arrive"])
def test_a_plan_makes_few_labels(spark, dense, labels_made, mode):
    q = spark.createDataFrame([(1, mode, "A", "B", 36010, 0.5), (2, mode, "B", "A", 50030, 0.5)],
                              "query_id long, mode string, dep_node string, arr_node string, t_sow int, threshold double")
    got = {(r.query_id, r.status, r.dep_sow, r.arr_sow) for r in plan(q, dense)[0].collect()}
    assert got == ({(1, "ok", 36240, 36540), (2, "ok", 50160, 50460)} if mode == "depart" else {(1, "ok", 35520, 35820), (2, "ok", 49680, 49980)})
    assert labels_made[0] < 60  # twice 59 and more before


@pytest.mark.parametrize("mode", ["depart", "arrive"])
def test_an_isochrone_ends_when_all_stops_are_reached(spark, dense, labels_made, mode):
    q = spark.createDataFrame([(1, "A", 36010, 7200, 0.5), (2, "B", 50030, 60, 0.5)],
                              "query_id long, start_node string, t_sow int, range_s int, threshold double")
    got = {(r[0], r[1], r[2]) for r in iso.isochrones(q, dense, mode=mode)[0].collect()}
    assert labels_made[0] < 40  # 28 each way before
    first = {(1, "A", 36010), (1, "B", 36540)} if mode == "depart" else {(1, "A", 36010), (1, "B", 35520)}
    assert got == first | {(2, "B", 50030)}


def test_bounds_follow_the_density(spark, dense):
    sparse = Timetable(dense.rides.where("edge_id < 100"), dense.walks, dense.grids)
    assert sparse.short_bounds(14400, 8) == []
    assert dense.short_bounds(14400, 8) == [3600, 7200]
    assert dense.short_bounds(14400, 8, 10) == [7200]


@pytest.mark.parametrize("mode", ["depart", "arrive"])
def test_the_last_hour_needs_no_rides_beyond(spark, dense, mode):
    use = dense.prepared(mode, transfers.SearchParams())
    q = spark.createDataFrame([(1, 36010, "A" if mode == "depart" else "B", "Z", 0.5, 1800)],
                              "query_id long, T int, start string, target string, threshold double, bound int")
    fr = journeys._virtual_labels(q).withColumns({"lo": F.col("to_t"), "hi": F.col("bound") + 1})
    kinds = {r.kind for r in transfers._via_keys(fr, mode, transfers.SearchParams(), use.look).collect()}
    assert kinds and not kinds & {transfers.BEYOND, transfers.ANY_BEYOND}
