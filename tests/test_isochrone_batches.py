"""Isochrones in batches: the same rows, and nothing but results left in the shared folder."""

import os
import random

import pytest

from tests.test_transfer_growth import timetable
from transitrisk.operators.transfers import SearchParams
from transitrisk.plans import isochrones as I
from transitrisk.plans.journeys import build_timetable
from transitrisk.session import ensure_checkpoint_dir, scratch_removed, write_counted


def folders(spark):
    return set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))


def asked(spark):
    rnd = random.Random(4)
    tt = timetable(spark, [(i, rnd.choice("ABCD"), rnd.choice("ABCD"), 36000 + 40 * i, 36600 + 40 * i, "g") for i in range(150)])
    q = [(rnd.choice([i, i, i, 3, None]), rnd.choice("ABCDZ"), 36000 + 300 * i, 3600, 0.5) for i in range(14)]
    return tt, spark.createDataFrame(q, "query_id long, start_node string, t_sow int, range_s int, threshold double")


def check(spark, monkeypatch, mode):
    tt, q = asked(spark)
    rows = lambda: [tuple(r) for r in I.isochrones(q, tt, mode=mode)[0].collect()]
    whole = rows()
    searches, search = [], I.search
    monkeypatch.setattr(I, "search", lambda *a, **k: searches.append(1) or search(*a, **k))
    monkeypatch.setattr(I, "QUERIES_A_PART", 2)
    monkeypatch.setattr(I, "FIRST_PARTS", 1)
    monkeypatch.setattr(I, "LABELS_AT_ONCE", 1)
    before = folders(spark)
    assert rows() == whole and len(whole) > 15 and len(searches) > 4
    left = {n.rsplit("-", 1)[0] for n in folders(spark) - before}
    assert left == {"isochrone-queries", "isochrone-reached"}  # rounds and their queries stayed before


def test_batches_find_the_same_and_leave_results_alone(spark, monkeypatch):
    check(spark, monkeypatch, "depart")


def test_batches_backward_find_the_same_and_leave_results_alone(spark, monkeypatch):
    check(spark, monkeypatch, "arrive")


def test_tables_written_for_a_batch_go_with_it(spark):
    before = folders(spark)
    with pytest.raises(ValueError), scratch_removed(spark):
        write_counted(spark.range(3), "batch-gone")
        part, n = write_counted(spark.range(4), "batch-kept", kept=True)
        raise ValueError
    assert n == part.count() == 4 and [x.rsplit("-", 1)[0] for x in folders(spark) - before] == ["batch-kept"]


def test_a_mode_is_prepared_when_it_is_searched(spark):
    stops = spark.createDataFrame([("A", 8.0, 47.0), ("B", 8.1, 47.0)], "stop string, lon double, lat double")
    laws = spark.createDataFrame([("g", 1.0, 0.0, 30.0)], "dist_id string, shape double, loc double, scale double")
    before = folders(spark)
    tt = build_timetable(spark, asked(spark)[0].rides, stops, laws)
    made = folders(spark) - before
    kinds = [x for top in made for x in os.listdir(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/{top}") if x.startswith("kinds")]
    assert len(made) == 1 and kinds == []  # both modes were written before
    tt.prepared("arrive", SearchParams())
    assert [x.rsplit("-", 1)[0] for x in folders(spark) - before - made] == ["timetable-kinds"] and len(tt._prepared) == 1
