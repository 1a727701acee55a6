"""Golden answers on the toy timetable (FIXTURES.md §4)."""

import pytest

from tests.toy import hm, toy_timetable
from transitrisk.plans.journeys import plan
from transitrisk.plans.isochrones import isochrones


@pytest.fixture(scope="module")
def tt(spark):
    return toy_timetable(spark)


def _plan(spark, tt, rows):
    q = spark.createDataFrame(rows, "query_id long, mode string, dep_node string, arr_node string, "
                                    "t_sow int, threshold double")
    summary, itin = plan(q, tt)
    s = {r.query_id: r for r in summary.collect()}
    legs = {}
    for r in itin.orderBy("query_id", "leg").collect():
        legs.setdefault(r.query_id, []).append(r)
    return s, legs


def test_depart_thresholds(spark, tt):
    t = hm("10:00")
    rows = [(i, "depart", "node1", "node5", t, th) for i, th in enumerate([0.04, 0.05, 0.5, 0.99, 1.0])]
    s, legs = _plan(spark, tt, rows)
    assert s[0].status == "ok" and s[0].arr_sow == hm("10:38")
    assert [l.trip_id for l in legs[0]] == [3, 4, 23]
    assert s[0].prob == pytest.approx(0.042298, abs=1e-6)
    for i in (1, 2, 3):
        assert s[i].status == "ok" and s[i].arr_sow == hm("10:40"), s[i]
        assert [l.trip_id for l in legs[i]] == [1], legs[i]
        assert s[i].prob == pytest.approx(1.0)
    assert s[4].status == "no_path"


def test_arrive_by(spark, tt):
    rows = [(0, "arrive", "node1", "node5", hm("10:41"), 0.5),
            (1, "arrive", "node1", "node5", hm("10:41"), 0.7),
            (2, "arrive", "node1", "node5", hm("10:42"), 0.5),
            (3, "arrive", "node1", "node5", hm("10:42"), 0.7)]
    s, legs = _plan(spark, tt, rows)
    assert s[0].dep_sow == hm("10:10") and [l.trip_id for l in legs[0]] == [3, 4, 1]
    assert s[0].prob == pytest.approx(0.659368, abs=1e-6)
    assert s[1].dep_sow == hm("10:05") and [l.trip_id for l in legs[1]] == [1]
    for i in (2, 3):
        assert s[i].dep_sow == hm("10:10") and [l.trip_id for l in legs[i]] == [3], legs[i]
        assert s[i].prob == pytest.approx(1.0)


def test_rejects_and_trivial(spark, tt):
    rows = [(0, "depart", "nowhere", "node5", hm("10:00"), 0.5),
            (1, "depart", "node1", "node5", hm("10:00"), 1.5),
            (2, "depart", "node2", "node2", hm("10:00"), 0.5)]
    s, _ = _plan(spark, tt, rows)
    assert s[0].status.startswith("rejected")
    assert s[1].status.startswith("rejected")
    assert s[2].status in ("trivial", "rejected: unknown arrival stop")


def test_isochrone(spark, tt):
    iq = spark.createDataFrame([(0, "node1", hm("10:00"), 1500, 0.5), (1, "node1", hm("10:00"), 1500, 0.9)],
                               "query_id long, start_node string, t_sow int, range_s int, threshold double")
    reached, _ = isochrones(iq, tt)
    got = {(r.query_id, r.stop): r.arr_sow for r in reached.collect()}
    exp05 = {"node1": "10:00", "node2": "10:13", "node3": "10:15", "node4": "10:22"}
    exp09 = {"node1": "10:00", "node2": "10:13", "node3": "10:15", "node4": "10:25"}
    assert {s: t for (q, s), t in got.items() if q == 0} == {k: hm(v) for k, v in exp05.items()}
    assert {s: t for (q, s), t in got.items() if q == 1} == {k: hm(v) for k, v in exp09.items()}
