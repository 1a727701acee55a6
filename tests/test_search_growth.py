"""Rounds of a search leave no shuffle files behind and do not move the timetable."""

import pytest
from pyspark.sql import functions as F

from tests.growth import plain_plans
from tests.test_transfer_growth import ASKED, timetable
from transitrisk.operators import transfers
from transitrisk.plans.journeys import _virtual_labels, search
from transitrisk.session import write_counted


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df, n = write_counted(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffle-test")
    assert n == 7 and sorted(r["k"] for r in df.collect()) == list(range(7))
    assert not shuffle_files(spark) - before


def moved_rides(plan):
    """Kept tables of rides that reach a join through a shuffle, and all that do not."""
    out, todo = [0, 0], [(plan, False)]
    while todo:
        node, moved = todo.pop()
        name = node.nodeName()
        if "InMemoryTableScan" in name and "edge_id" in node.simpleString(100):
            out[not moved] += 1
        moved = "Join" not in name and (moved or "Exchange" in name)
        todo += [(node.children().apply(i), moved) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize("mode", ["depart", "arrive"])
def test_a_round_moves_its_labels_alone(spark, mode):
    tt = timetable(spark, [(i % 5, "AB"[i % 2], "BC"[i % 2], 36000 + 60 * i, 36300 + 60 * i, "g") for i in range(60)])
    q = spark.createDataFrame([(i, 35999 if mode == "depart" else 39599, "A" if mode == "depart" else "C", "Z", 0.5, 7200) for i in range(20)], ASKED)
    labels = search(q, tt, mode, to_target=False)[0]
    use = tt.prepared(mode, transfers.SearchParams())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many labels
    try:
        with plain_plans(spark):
            boarded = transfers.expand(_virtual_labels(q), use.rides, use.links, tt.grids, mode, transfers.SearchParams(), use.cells, use.tables, use.look)
            moved = moved_rides(transfers.stay_aboard(boarded, use.rides, mode)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved[0] == 0 < moved[1] and labels.count() > 0
