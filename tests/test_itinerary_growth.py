"""Itineraries: pointers are followed once, over labels that are moved once, whoever reads the legs how often."""

from tests.growth import plain_plans
from tests.toy import toy_timetable
from transitrisk.plans import journeys
from transitrisk.plans.journeys import itinerary_edges, itinerary_stops, plan

QUERY = "query_id long, mode string, dep_node string, arr_node string, t_sow int, threshold double"


def steps(df):
    """Names of the plan's steps; a kept table is one."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        out.append(node.nodeName())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_pointers_are_followed_once_and_stay_where_they_are(spark, monkeypatch):
    written, write = {}, journeys.write_counted

    def kept(df, name):
        written.setdefault(name, []).append(steps(df))
        return write(df, name)
    monkeypatch.setattr(journeys, "write_counted", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with plain_plans(spark):
            tt = toy_timetable(spark)
            q = spark.createDataFrame([(1, "depart", "node1", "node5", 36000, 0.04), (2, "depart", "node1", "node5", 36000, 0.5)], QUERY)
            _, legs = plan(q, tt)
            rides = [(r.query_id, r.trip_id) for r in legs.orderBy("query_id", "leg").collect()]
            assert rides == [(1, 3), (1, 4), (1, 23), (2, 1)]
            # three joins of the longest path: the answers move, the pointers do not
            (followed,) = written["search-paths"]
            assert followed.count("SortMergeJoin") == followed.count("Exchange") == 3
            assert not {"Exchange", "SortMergeJoin"} & set(steps(legs))
            stops = spark.createDataFrame([(f"node{i}", 8.0, 47.0) for i in range(1, 6)], "stop string, lon double, lat double")
            table = itinerary_stops(itinerary_edges(legs, tt.rides), stops)
            assert steps(table).count("SortMergeJoin") == 1  # the stops' own
            assert [(r.query_id, r.stop) for r in table.orderBy("query_id", "pos").collect()] == [
                (1, "node1"), (1, "node3"), (1, "node4"), (1, "node5"), (2, "node1"), (2, "node2"), (2, "node4"), (2, "node5")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
