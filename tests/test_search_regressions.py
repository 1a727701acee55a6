"""Cases that once gave wrong, cut or lost answers."""

import pytest

from transitrisk.operators.delays import cdf_grids
from transitrisk.operators.walks import walk_pairs
from transitrisk.plans.flow import build_timetable_from_obs
from transitrisk.plans.isochrones import isochrones
from transitrisk.plans.journeys import (DAY_S, Timetable, clock_queries, itinerary_edges, itinerary_stops, plan,
                                        prepare_rides)

QUERY = "query_id long, mode string, dep_node string, arr_node string, t_sow int, threshold double"


def hm(text):
    h, m = text.split(":")
    return int(h) * 3600 + int(m) * 60


def make(spark, rows, walks):
    e = spark.createDataFrame([(i, t, 0, a, b, hm(d), hm(r), "law") for i, (t, a, b, d, r) in enumerate(rows, 1)],
                              "edge_id long, trip_id long, day_start int, dep_node string, arr_node string, "
                              "dep_sow int, arr_sow int, dist_id string")
    w = spark.createDataFrame([(a, b, s) for a, b, s in walks] + [(b, a, s) for a, b, s in walks],
                              "dep_node string, arr_node string, walk_s int")
    law = spark.createDataFrame([("law", 1.0, 0.0, 30.0)], "dist_id string, shape double, loc double, scale double")
    return Timetable(prepare_rides(e), w, cdf_grids(law))


@pytest.fixture(scope="module")
def late_walk(spark):
    return make(spark, [(1, "A", "B", "09:00", "12:02"), (2, "A", "C", "11:50", "11:55"), (3, "B", "D", "12:30", "12:40"),
                        (3, "D", "E", "12:41", "12:50")], [("C", "B", 600), ("X", "Y", 60)])


def test_walk_past_the_pass_bound_is_not_final(spark, late_walk):
    q = spark.createDataFrame([(1, "depart", "A", "B", hm("08:00"), 0.5)], QUERY)
    for passes in ((4 * 3600, DAY_S), (DAY_S,)):
        r = plan(q, late_walk, deepening=passes)[0].first()
        assert (r.status, r.arr_sow) == ("ok", hm("12:02"))


def test_every_query_has_one_outcome(spark, late_walk):
    rows = [(1, "Depart", "A", "B", hm("08:00"), 0.5), (2, None, "A", "B", hm("08:00"), 0.5),
            (3, "depart", "A", "B", hm("08:00"), None), (4, "depart", "A", "B", hm("08:00"), 0.5),
            (4, "arrive", "A", "B", hm("13:00"), 0.5), (5, "depart", "A", "B", None, 0.5),
            (None, "depart", "A", "B", hm("08:00"), 0.5), (6, "depart", "A", "Q", hm("08:00"), 0.5),
            (7, "arrive", "A", "B", hm("13:00"), 0.5)]
    got = sorted(((r.query_id or 0, r.status) for r in plan(spark.createDataFrame(rows, QUERY), late_walk)[0].collect()))
    assert got == [(0, "rejected: query_id missing"), (1, "rejected: unknown mode"), (2, "rejected: unknown mode"),
                   (3, "rejected: threshold outside [0, 1]"), (4, "rejected: duplicate query_id"),
                   (4, "rejected: duplicate query_id"), (5, "rejected: time missing or malformed"),
                   (6, "rejected: unknown arrival stop"), (7, "ok")]


def test_walk_only_stops_are_valid(spark, late_walk):
    q = spark.createDataFrame([(1, "depart", "C", "B", hm("08:00"), 0.5), (2, "depart", "X", "Y", hm("08:00"), 0.5),
                               (3, "arrive", "X", "Y", hm("08:00"), 0.5)], QUERY)
    got = {r.query_id: r for r in plan(q, late_walk)[0].collect()}
    assert got[1].status == "ok" and got[1].arr_sow == hm("08:10")
    assert (got[2].arr_sow, got[2].dep_sow) == (hm("08:00") + 60, hm("08:00"))
    assert (got[3].arr_sow, got[3].dep_sow) == (hm("08:00"), hm("08:00") - 60)


def test_isochrones_both_ways(spark, late_walk):
    iq = spark.createDataFrame([(1, "A", hm("08:00"), 5 * 3600, 0.5)], "query_id long, start_node string, t_sow int, range_s int, threshold double")
    out = {r.stop: r.arr_sow for r in isochrones(iq, late_walk)[0].collect()}
    assert out == {"A": hm("08:00"), "B": hm("12:02"), "C": hm("11:55"), "D": hm("12:40"), "E": hm("12:50")}
    # from A to E the plan and the backward isochrone of E agree
    q = spark.createDataFrame([(1, "arrive", "A", "E", hm("13:00"), 0.5)], QUERY)
    best = plan(q, late_walk)[0].first()
    iq = spark.createDataFrame([(1, "E", hm("13:00"), 5 * 3600, 0.5)], iq.schema)
    back = [(r.stop, r.dep_sow) for r in isochrones(iq, late_walk, mode="arrive")[0].collect()]
    assert dict(back)["A"] == best.dep_sow
    assert back == sorted(back, key=lambda r: (-r[1], r[0]))


def test_edges_and_stops_of_an_itinerary(spark):
    late_walk = make(spark, [(1, "A", "B", "09:00", "12:02"), (3, "B", "D", "12:30", "12:40"), (3, "D", "E", "12:41", "12:50")],
                     [("C", "B", 600)])
    q = spark.createDataFrame([(1, "depart", "A", "E", hm("08:00"), 0.5)], QUERY)
    edges = itinerary_edges(plan(q, late_walk)[1], late_walk.rides)
    assert [(r.dep_node, r.arr_node, r.trip_id) for r in edges.orderBy("step").collect()] == [
        ("A", "B", 1), ("B", "D", 3), ("D", "E", 3)]
    stops = spark.createDataFrame([("E", 8.5, 47.4)], "stop string, lon double, lat double")
    got = [(r.stop, r.arr_clock, r.dep_clock, r.lon) for r in itinerary_stops(edges, stops).orderBy("pos").collect()]
    assert got == [("A", None, "09:00:00", None), ("B", "12:02:00", "12:30:00", None), ("D", "12:40:00", "12:41:00", None),
                   ("E", "12:50:00", None, 8.5)]


def test_higher_threshold_is_never_earlier(spark, late_walk):
    q = spark.createDataFrame([(i, "depart", "A", "E", hm("08:00"), i / 10) for i in range(10)], QUERY)
    arr = [r.arr_sow for r in plan(q, late_walk)[0].orderBy("query_id").collect()]
    known = [a for a in arr if a is not None]
    assert known == sorted(known) and None not in arr[:len(known)]


def test_chains_of_links_are_walked_one_at_a_time(spark):
    tt = make(spark, [(1, "A", "B", "09:00", "09:10"), (2, "E", "F", "09:40", "09:50"), (3, "B", "A", "09:20", "09:30")],
              [("B", "C", 100), ("C", "D", 100), ("D", "E", 100), ("B", "D", 500), ("F", "G", 60), ("G", "H", 60), ("H", "I", 60), ("Z", "A", 30), ("Y", "Z", 30), ("X", "Y", 30)])
    q = spark.createDataFrame([(1, "depart", "X", "I", hm("08:00"), 0.5), (2, "arrive", "X", "I", hm("10:00"), 0.5),
                               (3, "depart", "B", "E", hm("08:00"), 0.5)], QUERY)
    summary, legs = plan(q, tt)
    got = {r.query_id: (r.status, r.dep_sow, r.arr_sow, r.n_rides) for r in summary.collect()}
    assert got[1] == ("ok", hm("08:00"), hm("09:50") + 180, 2) and got[3] == ("ok", hm("08:00"), hm("08:05"), 0)
    assert got[2] == ("ok", hm("09:00") - 90, hm("09:50") + 180, 2)
    path = {i: [(r.kind, r.dep_node, r.arr_node, r.dep_sow, r.arr_sow) for r in legs.where(f"query_id = {i}").orderBy("leg").collect()] for i in (1, 2)}
    assert [p[1] + p[2] for p in path[1]] == ["XY", "YZ", "ZA", "AB", "BC", "CD", "DE", "EF", "FG", "GH", "HI"]
    assert [p[1:3] for p in path[1]] == [p[1:3] for p in path[2]]
    assert path[1][0][3:] == (hm("08:00"), hm("08:00") + 30) and path[2][0][3:] == (hm("09:00") - 90, hm("09:00") - 60)
    assert path[1][6] == ("walk", "D", "E", hm("09:10") + 200, hm("09:10") + 300) == path[2][6]
    iq = spark.createDataFrame([(1, "X", hm("08:00"), 2 * 3600, 0.5)], "query_id long, start_node string, t_sow int, range_s int, threshold double")
    reached = {r.stop: r.arr_sow for r in isochrones(iq, tt)[0].collect()}
    assert reached["A"] == hm("08:00") + 90 and reached["D"] == hm("09:10") + 200 and reached["I"] == hm("09:50") + 180
    assert len(reached) == 12


def test_clock_queries(spark):
    q = spark.createDataFrame([(1, "08:05:00", 2), (2, "24:00:00", 2), (3, "8:05", 2), (4, "00:00:01", None), (5, "10:00:00", 7)],
                              "query_id long, clock string, day int")
    got = {r.query_id: r.t_sow for r in clock_queries(q).collect()}
    assert got[1] == 2 * DAY_S + hm("8:05") and [got[i] for i in (2, 3, 5)] == [None] * 3 and got[4] % DAY_S == 1


def test_walk_pairs_at_the_edges_of_the_map(spark):
    stops = spark.createDataFrame([("w", 179.9999, 10.0), ("e", -179.9999, 10.0), ("p", 0.0, 89.9999), ("q", 180.0, 89.9999),
                                   ("far", 90.0, 10.0)], "stop string, lon double, lat double")
    got = {(r.dep_node, r.arr_node) for r in walk_pairs(stops).collect()}
    assert got == {("w", "e"), ("e", "w"), ("p", "q"), ("q", "p")}


def test_whole_flow_from_observations(spark):
    rows = []
    for day in range(30):
        for trip, base, spread in ((1, 8, 40), (2, 9, 200)):
            for i, stop in enumerate("ABC"):
                at = base * 3600 + i * 600
                rows.append((trip, stop, 0, 0, at, at + 30, (day * 7 + i * 3) % spread, 0))
    obs = spark.createDataFrame(rows, "trip_id long, stop string, day_start int, week_day int, arr_sod int, dep_sod int, "
                                      "arrival_delay long, departure_delay long")
    stops = spark.createDataFrame([("A", 8.0, 47.0), ("B", 8.1, 47.0), ("C", 8.2, 47.0)], "stop string, lon double, lat double")
    tt, laws = build_timetable_from_obs(spark, obs, stops, k=2)
    assert laws.count() == 2 and laws.where("shape is not null and shape <> 1").count() >= 1
    q = spark.createDataFrame([(1, "depart", "A", "C", hm("07:00"), 0.5), (2, "depart", "A", "C", hm("08:30"), 0.5)], QUERY)
    got = {r.query_id: (r.status, r.arr_sow) for r in plan(q, tt)[0].collect()}
    assert got == {1: ("ok", hm("08:20")), 2: ("ok", hm("09:20"))}


def test_swapped_csv_header_is_an_error(spark, tmp_path):
    from transitrisk.sources.actuals import read_actuals
    (tmp_path / "a.csv").write_text("BETRIEBSTAG;FAHRT_BEZEICHNER\n01.01.2018;t1\n")
    (tmp_path / "b.csv").write_text("FAHRT_BEZEICHNER;BETRIEBSTAG\nt2;02.01.2018\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_actuals(spark, str(tmp_path)).collect()
