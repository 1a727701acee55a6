"""Streaming ingest gives the same statistics as the batch path."""

from transitrisk.operators.timetable import delay_stats
from transitrisk.sources.actuals import normalize_actuals, read_actuals
from transitrisk.streaming.observations import FILE_COLUMNS, start_delay_stats


def _line(day, trip, stop, arr, arr_a):
    vals = dict.fromkeys(FILE_COLUMNS, "")
    vals.update({"BETRIEBSTAG": day, "FAHRT_BEZEICHNER": trip, "HALTESTELLEN_NAME": stop,
                 "ANKUNFTSZEIT": f"{day} {arr}", "AN_PROGNOSE": f"{day} {arr_a}",
                 "AN_PROGNOSE_STATUS": "GESCHAETZT", "DURCHFAHRT_TF": "false", "FAELLT_AUS_TF": "false"})
    return ";".join(vals[c] for c in FILE_COLUMNS)


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    header = ";".join(FILE_COLUMNS)
    (src / "d1.csv").write_text("\n".join([header, _line("02.10.2017", "t1", "A", "08:00", "08:00:30"),
                                           _line("02.10.2017", "t1", "B", "08:05", "08:06:00")]) + "\n")
    (src / "d2.csv").write_text("\n".join([header, _line("09.10.2017", "t1", "A", "08:00", "08:01:10"),
                                           _line("09.10.2017", "t1", "B", "08:05", "08:05:20")]) + "\n")
    q = start_delay_stats(spark, str(src), name="ds_test", checkpoint=str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = {(r.stop, r.arr_sod): (r.num_delays, r.mean_delay) for r in spark.table("ds_test").collect()}
    batch = delay_stats(normalize_actuals(read_actuals(spark, str(src / "*.csv"))))
    exp = {(r.stop, r.arr_sod): (r.num_delays, r.mean_delay) for r in batch.collect()}
    assert got == exp
    assert got[("A", 8 * 3600)] == (2, 50.0)
