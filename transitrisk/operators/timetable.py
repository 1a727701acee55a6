"""Weekly timetable from observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitrisk.functions.timeops import DAY_S, duration_minutes

GROUP_KEY = ["trip_id", "day_start", "week_day", "arr_sod", "dep_sod", "stop"]
RUN_KEY = ["trip_id", "day_start"]
MAX_EDGE_MIN = 180


def delay_stats(obs: DataFrame, with_lists: bool = False) -> DataFrame:
    """Per (trip, start day, weekday, times, stop): mean, sample std and count of
    the arrival delay (A2-A4). Aggregates ignore null (unmeasured) delays.

    ``with_lists`` adds the list of delays (A3); keep it off on big inputs and
    use the long form (``edge_delays``) instead.
    """
    aggs = [F.avg("arrival_delay").alias("mean_delay"),
            F.stddev_samp("arrival_delay").alias("std_delay"),
            F.count("arrival_delay").cast("int").alias("num_delays"),
            F.avg("departure_delay").alias("mean_dep_delay")]
    if with_lists:
        aggs.append(F.collect_list("arrival_delay").alias("delays"))
    return obs.groupBy(*GROUP_KEY).agg(*aggs)


def consecutive_pairs(stats: DataFrame) -> DataFrame:
    """Pairs each stop row with the next one inside its run (W1), and the last
    row with the first one a week later (W2). Arrival-side statistics always
    come from the arrival row. Adds ``delta`` in minutes (F8).
    """
    rel_day = F.pmod(F.col("week_day") - F.col("day_start"), F.lit(7))
    s = stats.withColumn("rel_day", rel_day)
    w = Window.partitionBy(*RUN_KEY).orderBy("rel_day", "arr_sod", "dep_sod", "stop")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    arrival_cols = ["stop", "week_day", "arr_sod", "dep_sod", "rel_day", "mean_delay",
                    "std_delay", "num_delays"] + (["delays"] if "delays" in stats.columns else [])
    nxt = {f"n_{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in arrival_cols}
    p = s.withColumns({"wrap": F.lead("stop").over(w).isNull(),
                       "pos": F.row_number().over(w), **nxt})
    return pair_columns(p)


def pair_columns(p: DataFrame) -> DataFrame:
    """The pairs' columns from rows with their place (``pos``, ``wrap``) and the
    following row's columns under ``n_`` names."""
    day_offset = (F.col("n_rel_day") - F.col("rel_day")
                  + F.when(F.col("wrap"), F.lit(7)).otherwise(F.lit(0)))
    return p.select(
        *RUN_KEY, "pos", "wrap",
        F.col("stop").alias("dep_node"), F.col("n_stop").alias("arr_node"),
        F.col("week_day").alias("dep_day"), F.col("n_week_day").alias("arr_day"),
        F.col("dep_sod"), F.col("n_arr_sod").alias("arr_sod"),
        F.col("n_dep_sod").alias("arr_row_dep_sod"),
        day_offset.alias("day_offset"),
        duration_minutes("dep_sod", "n_arr_sod", day_offset).alias("delta"),
        F.col("n_mean_delay").alias("mean_delay"), F.col("n_std_delay").alias("std_delay"),
        F.col("n_num_delays").alias("num_delays"),
        *([F.col("n_delays").alias("delays")] if "delays" in p.columns else []),
    )


def anomalies(pairs: DataFrame) -> DataFrame:
    """Pairs departing after they arrive on the same day (P8); the week
    wrap-around pair is never an anomaly."""
    return pairs.where((F.col("dep_day") == F.col("arr_day")) & (F.col("dep_sod") > F.col("arr_sod"))
                       & ~F.col("wrap"))


def bridge_repair(pairs: DataFrame, bad_stop: str) -> DataFrame:
    """In runs holding a P8 anomaly, bridge over ``bad_stop`` (W3, J6): a pair
    arriving there takes every arrival-side column of the run's next pair, and
    pairs departing from it are dropped. Other runs are unchanged."""
    w = Window.partitionBy(*RUN_KEY).orderBy("pos")
    whole = Window.partitionBy(*RUN_KEY)
    anomalous = F.max(((F.col("dep_day") == F.col("arr_day")) & (F.col("dep_sod") > F.col("arr_sod"))
                       & ~F.col("wrap")).cast("int")).over(whole) == 1
    arrival_cols = ["arr_node", "arr_day", "arr_sod", "arr_row_dep_sod", "mean_delay",
                    "std_delay", "num_delays"] + (["delays"] if "delays" in pairs.columns else [])
    p = pairs.withColumn("_bad_run", anomalous)
    bridge = (F.col("_bad_run") & (F.col("arr_node") == F.lit(bad_stop))
              & F.lead("pos").over(w).isNotNull())
    repaired = p.withColumns({c: F.when(bridge, F.lead(c).over(w)).otherwise(F.col(c))
                              for c in arrival_cols})
    repaired = repaired.withColumn(
        "day_offset", F.pmod(F.col("arr_day") - F.col("dep_day"), F.lit(7))
        + F.when(F.col("wrap"), F.lit(7)).otherwise(F.lit(0)))
    repaired = repaired.withColumn("delta", duration_minutes("dep_sod", "arr_sod", F.col("day_offset")))
    keep = ~(F.col("_bad_run") & (F.col("dep_node") == F.lit(bad_stop)))
    return repaired.where(keep).drop("_bad_run")


def valid_edges(pairs: DataFrame, max_minutes: int = MAX_EDGE_MIN) -> DataFrame:
    """0 ≤ duration < ``max_minutes`` and distinct end stops."""
    return pairs.where((F.col("delta") >= 0) & (F.col("delta") < max_minutes)
                       & (F.col("dep_node") != F.col("arr_node")))


def support_filter(edges: DataFrame, min_support: int = 20) -> DataFrame:
    """Keep edges observed at least ``min_support`` times."""
    return edges.where(F.col("num_delays") >= min_support)


def support_summary(edges: DataFrame, col: str = "num_delays") -> DataFrame:
    """count, mean, std, min, quartiles, max of a column (A5)."""
    c = F.col(col).cast("double")
    return edges.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"), F.percentile(c, 0.25).alias("q25"),
        F.percentile(c, 0.5).alias("q50"), F.percentile(c, 0.75).alias("q75"),
        F.max(c).alias("max"))


def finalize_edges(edges: DataFrame) -> DataFrame:
    """Adds a stable edge id and second-of-week times (arrival may pass the
    end of the week)."""
    dep_sow = F.col("dep_day") * DAY_S + F.col("dep_sod")
    arr_sow = dep_sow + F.col("delta") * 60
    return edges.withColumns({
        "edge_id": F.xxhash64(*RUN_KEY, "dep_day", "dep_sod", "arr_day", "arr_sod", "dep_node", "arr_node"),
        "dep_sow": dep_sow.cast("int"),
        "arr_sow": arr_sow.cast("int"),
    })


def trip_pool(obs: DataFrame) -> DataFrame:
    """Per trip: number of stop rows and distinct stops."""
    return obs.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("stop").alias("n_stops"),
        F.count_distinct("week_day").alias("n_days"))


def top_edges(edges: DataFrame, n: int = 10) -> DataFrame:
    """Preview: the ``n`` best-supported edges with a full tie-break."""
    return edges.orderBy(F.desc("num_delays"), "trip_id", "day_start", "dep_day",
                         "dep_sod", "dep_node", "arr_node").limit(n)
