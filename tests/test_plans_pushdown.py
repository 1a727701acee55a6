"""Column pruning and filter pushdown reach the Parquet scan."""

from transitrisk.operators.timetable import delay_stats
from transitrisk.sources import testdata as V


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stats_read_only_needed_columns(spark, sf_dir):
    stats = delay_stats(V.obs(V.table(spark, sf_dir, "events")))
    plan = _plan(stats)
    # event_id and props are never read: only the four columns the statistics use
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan, plan


def test_filter_pushed_to_scan(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").where("value > 100").select("event_id")
    plan = _plan(e)
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,100.0)]" in plan, plan
