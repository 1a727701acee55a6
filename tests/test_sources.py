"""Station lines and stop-level actuals (FIXTURES.md §1, §2)."""

import math

import pytest
from pyspark.sql import functions as F

from transitrisk.functions.geo import haversine_m
from transitrisk.sources import actuals as AC
from transitrisk.sources import stations as ST


def test_station_parse_fixed_layout(spark, tmp_path):
    p = tmp_path / "stations.txt"
    p.write_text("8503000   8.540192  47.378177  408 % Zürich HB\n"
                 "garbage line without separator\n"
                 "8503001   x.bad  47.1  400 % Broken\n"
                 "8503006   8.544108  47.411523  443 % Zürich Oerlikon\n", encoding="utf-8")
    df = ST.parse_station_lines(ST.read_station_lines(spark, str(p)))
    rows = {r.stop: r for r in df.collect()}
    assert set(rows) == {"Zürich HB", "Zürich Oerlikon"}
    assert rows["Zürich HB"].lon == pytest.approx(8.540192)
    assert rows["Zürich HB"].lat == pytest.approx(47.378177)
    assert rows["Zürich HB"].station_id == "8503000"


def test_haversine_reference_distances(spark):
    df = spark.createDataFrame([(47.378177, 8.540192, 47.378177, 8.590192),
                                (47.378177, 8.540192, 47.428177, 8.540192)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_m("a", "b", "c", "d")).collect()]
    assert got[0] == pytest.approx(3764.8, abs=0.1)
    assert got[1] == pytest.approx(5559.7, abs=0.1)


def test_radius_filter(spark):
    s = spark.createDataFrame([("c", 8.54, 47.378), ("near", 8.55, 47.378), ("far", 8.80, 47.378)],
                              "stop string, lon double, lat double")
    got = {r.stop for r in ST.within_radius(s, "c", 1000.0).collect()}
    assert got == {"c", "near"}


HEADER = ("BETRIEBSTAG;FAHRT_BEZEICHNER;BETREIBER_ABK;BETREIBER_NAME;PRODUKT_ID;LINIEN_ID;LINIEN_TEXT;"
          "VERKEHRSMITTEL_TEXT;ZUSATZFAHRT_TF;FAELLT_AUS_TF;HALTESTELLEN_NAME;ANKUNFTSZEIT;AN_PROGNOSE;"
          "AN_PROGNOSE_STATUS;ABFAHRTSZEIT;AB_PROGNOSE;AB_PROGNOSE_STATUS;DURCHFAHRT_TF")


def row(trip, stop, arr="", arr_a="", arr_s="", dep="", dep_a="", dep_s="", day="03.10.2017",
        thru="false", cancel="false"):
    return ";".join([day, trip, "SBB", "Schweizerische Bundesbahnen", "Zug", "1", "S1", "S", "false", cancel,
                     stop, arr, arr_a, arr_s, dep, dep_a, dep_s, thru])


@pytest.fixture(scope="module")
def obs(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("ist")
    lines = [HEADER,
             # first stop: no arrival, departure measured
             row("t1", "A", dep="03.10.2017 08:00", dep_a="03.10.2017 08:00:30", dep_s="GESCHAETZT"),
             # the example: scheduled 08:04, actual 08:05:10 → 70 s
             row("t1", "B", arr="03.10.2017 08:04", arr_a="03.10.2017 08:05:10", arr_s="GESCHAETZT",
                 dep="03.10.2017 08:05", dep_a="03.10.2017 08:05:40", dep_s="PROGNOSE"),
             # last stop: no departure
             row("t1", "C", arr="03.10.2017 08:10", arr_a="03.10.2017 08:10:00", arr_s="GESCHAETZT"),
             # neither side measured → dropped
             row("t2", "A", arr="03.10.2017 09:00", arr_a="", arr_s="PROGNOSE", dep="03.10.2017 09:01"),
             # unparsable actual time → null delay, row kept (departure measured)
             row("t2", "B", arr="03.10.2017 09:04", arr_a="xx", arr_s="GESCHAETZT",
                 dep="03.10.2017 09:05", dep_a="03.10.2017 09:05:00", dep_s="GESCHAETZT"),
             # exactly 1000 s late → outlier, dropped; 999 s kept
             row("t3", "A", arr="03.10.2017 10:00", arr_a="03.10.2017 10:16:40", arr_s="GESCHAETZT"),
             row("t3", "B", arr="03.10.2017 10:00", arr_a="03.10.2017 10:16:39", arr_s="GESCHAETZT"),
             row("t3", "C", arr="03.10.2017 10:20", arr_a="03.10.2017 10:03:21", arr_s="GESCHAETZT"),
             # pass-through and cancelled rows are dropped
             row("t4", "A", arr="03.10.2017 11:00", arr_a="03.10.2017 11:00:05", arr_s="GESCHAETZT", thru="true"),
             row("t4", "B", arr="03.10.2017 11:00", arr_a="03.10.2017 11:00:05", arr_s="GESCHAETZT", cancel="true"),
             # midnight crossing: arrives 23:59, departs 00:01 next day
             row("t5", "M", arr="08.10.2017 23:59", arr_a="09.10.2017 00:00:10", arr_s="GESCHAETZT",
                 dep="09.10.2017 00:01", dep_a="09.10.2017 00:01:00", dep_s="GESCHAETZT", day="08.10.2017"),
             ]
    (d / "day1.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return {(r.trip_id, r.stop): r for r in AC.normalize_actuals(AC.read_actuals(spark, str(d / "*.csv"))).collect()}


def test_actuals_delays(obs):
    assert obs[("t1", "B")].arrival_delay == 70
    assert obs[("t1", "B")].departure_delay is None  # PROGNOSE is not measured
    assert obs[("t1", "A")].departure_delay == 30 and obs[("t1", "A")].arrival_delay is None
    assert obs[("t1", "A")].arr_sod == 8 * 3600  # falls back to the departure time
    assert obs[("t1", "C")].arrival_delay == 0


def test_actuals_filters(obs):
    assert ("t2", "A") not in obs
    assert obs[("t2", "B")].arrival_delay is None and obs[("t2", "B")].departure_delay == 0
    assert ("t3", "A") not in obs
    assert obs[("t3", "B")].arrival_delay == 999
    assert obs[("t3", "C")].arrival_delay == -999
    assert ("t4", "A") not in obs and ("t4", "B") not in obs


def test_actuals_days(obs):
    m = obs[("t5", "M")]
    assert m.week_day == 6 and m.day_start == 6  # Sunday
    assert m.arr_sod == 23 * 3600 + 59 * 60
    assert m.dep_sod == 86400 + 60  # Sunday → Monday crossing keeps counting
    assert obs[("t1", "A")].week_day == 1  # 03.10.2017 is a Tuesday
