"""Daily files as a dated store; rides by departure day."""

import os
import re

from test_sources import HEADER, row
from transitrisk.sources import dated as DT
from transitrisk.sources.storage import read_stage


def write_day(folder, day, trips, delay=30):
    lines = [row(t, "Bern", arr=f"{day} 08:00", arr_a=f"{day} 08:00:{delay}", arr_s="GESCHAETZT", day=day) for t in trips]
    (folder / f"{day}.csv").write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")


def held(spark, store, **kw):
    return sorted((str(r["service_date"]), r["trip_id"], r["arrival_delay"]) for r in DT.read_days(spark, store, **kw).collect())


def test_loads_only_new_and_changed_files(spark, tmp_path):
    files, store = tmp_path / "in", str(tmp_path / "store")
    files.mkdir()
    glob = str(files / "*.csv")
    assert DT.read_days(spark, store).count() == 0
    write_day(files, "03.10.2017", ["1", "2"])
    write_day(files, "04.10.2017", ["3"])
    assert DT.load_new_days(spark, glob, store) == 2
    assert DT.load_new_days(spark, glob, store) == 0
    write_day(files, "05.10.2017", ["4"])
    write_day(files, "03.10.2017", ["1", "5", "66"], delay=40)           # corrected: other rows, other size
    assert {os.path.basename(r["file"]) for r in DT.new_files(spark, glob, store).collect()} == {"03.10.2017.csv", "05.10.2017.csv"}
    # the untouched file's bytes change behind its size and time: it is not opened again
    untouched = files / "04.10.2017.csv"
    was = untouched.stat()
    untouched.write_bytes(b"?" * was.st_size)
    os.utime(untouched, ns=(was.st_atime_ns, was.st_mtime_ns))
    assert DT.load_new_days(spark, glob, store) == 2
    want = [("2017-10-03", "1", 40), ("2017-10-03", "5", 40), ("2017-10-03", "66", 40), ("2017-10-04", "3", 30), ("2017-10-05", "4", 30)]
    assert held(spark, store) == want
    assert held(spark, store, first="2017-10-04", last="2017-10-04") == [want[3]]


def test_rows_of_a_broken_load_do_not_count(spark, tmp_path):
    files, store = tmp_path / "in", str(tmp_path / "store")
    files.mkdir()
    write_day(files, "03.10.2017", ["1"])
    DT.load_new_days(spark, str(files / "*.csv"), store)
    # a load that wrote its rows and died before it named its files
    read_stage(spark, f"{store}/days/load=1").write.partitionBy("service_date").parquet(f"{store}/days/load=2")
    assert len(held(spark, store)) == 1
    write_day(files, "04.10.2017", ["2"])
    assert DT.load_new_days(spark, str(files / "*.csv"), store) == 1
    assert [d for d, _, _ in held(spark, store)] == ["2017-10-03", "2017-10-04"]


def test_a_file_without_measured_rows_is_loaded_once(spark, tmp_path):
    files, store = tmp_path / "in", str(tmp_path / "store")
    files.mkdir()
    (files / "a.csv").write_text(HEADER + "\n", encoding="utf-8")
    assert DT.load_new_days(spark, str(files / "*.csv"), store) == 1
    assert DT.load_new_days(spark, str(files / "*.csv"), store) == 0
    assert DT.read_days(spark, store).count() == 0


def plan_text(df):
    return df._jdf.queryExecution().toString()


def scanned_folders(df):
    """Partitions that the scan of the executed plan read."""
    df.collect()
    return re.findall(r"dynamicpruningexpression\([^)]*\)|PartitionFilters: \[[^\]]*\]", plan_text(df))


def test_days_prune_folders(spark, tmp_path):
    rides = spark.createDataFrame([(d * 10 + k, f"s{k}", d * 86400 + 30_000) for d in range(7) for k in range(5)],
                                  "edge_id long, dep_node string, dep_sow int")
    path = DT.write_rides_by_day(rides, str(tmp_path / "rides"))
    q = spark.createDataFrame([(1, 6 * 86400 + 50_000), (2, -5), (3, None)], "query_id long, T int")
    assert {r["dep_day"] for r in DT.days_needed(q, "depart").collect()} == {6, 0}
    assert {r["dep_day"] for r in DT.days_needed(q.where("query_id = 1"), "arrive").collect()} == {5, 6}
    early = spark.createDataFrame([(1, 3600)], "query_id long, T int")
    assert {r["dep_day"] for r in DT.days_needed(early, "arrive").collect()} == {5, 6, 0}
    week = DT.days_needed(q, "depart", horizon_s=30 * 86400)
    assert {r["dep_day"] for r in week.collect()} == set(range(7))
    needed = DT.rides_needed(spark, path, q, "depart")
    assert {r["edge_id"] // 10 for r in needed.collect()} == {6, 0} and needed.count() == 10
    assert "dynamicpruningexpression" in " ".join(scanned_folders(needed))


def test_days_of_a_store_prune_folders(spark, tmp_path):
    files, store = tmp_path / "in", str(tmp_path / "store")
    files.mkdir()
    for day in ("03.10.2017", "04.10.2017"):
        write_day(files, day, ["1"])
    DT.load_new_days(spark, str(files / "*.csv"), store)
    text = plan_text(DT.read_days(spark, store, first="2017-10-04"))
    assert re.search(r"PartitionFilters: \[[^\]]*service_date#\d+ >= 2017-10-04", text)
