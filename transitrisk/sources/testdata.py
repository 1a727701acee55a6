"""Derived transit views over the driver's test tables.

The driver's tables hold no transit feed, so fixed rules turn them into
one (the same rules are written once in DataFrame form and once in SQL
for the DuckDB oracle; the two must stay in step):

* ``obs``      – observations from ``events``: trip = user_id % 5, stop =
                 event_type, scheduled time from a 4-hour slot plus a
                 per-stop offset, delay = floor(value) seconds.
* ``rides``    – a runnable timetable from ``events``: one vehicle run per
                 (user_id, date), stops event_type_k with k = floor(value/5)
                 mod 4, consecutive events form ride edges.
* ``jstops``   – coordinates of the ride stops by a fixed rule.
* ``sstops``   – a stop grid from ``supplier`` for the geometric operators.
* ``exp_dists``– exponential delay laws (gamma shape 1) per arrival stop,
                 scale = mean value, which DuckDB can evaluate in closed form.
* ``plan_queries`` / ``iso_queries`` – one query per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitrisk.functions.timeops import DAY_S

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed values of the derived views (shared with the SQL below).
OBS_TRIPS = 5
SLOT_S = 4 * 3600
PURCHASE_DWELL_S = 300
DWELL_S = 60
JSTOP_LON0, JSTOP_LAT0, JSTOP_DLON, JSTOP_DLAT = 8.50, 47.37, 0.02, 0.0022
SSTOP_LON0, SSTOP_LAT0, SSTOP_STEP, SSTOP_COLS = 8.30, 47.30, 0.004, 25
MAX_EDGE_S = 3 * 3600
DEFAULT_THRESHOLD = 0.5
ISO_RANGE_S = 2 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def obs(events: DataFrame) -> DataFrame:
    arr = ((F.hour("ts") / 4).cast("int") * SLOT_S + F.lit(60) * (F.ascii("event_type") - 97))
    dwell = F.when(F.col("event_type") == "purchase", PURCHASE_DWELL_S).otherwise(DWELL_S)
    return events.select(
        (F.col("user_id") % OBS_TRIPS).alias("trip_id"),
        F.col("event_type").alias("stop"),
        F.to_date("ts").alias("service_date"),
        F.weekday("ts").alias("day_start"),
        F.weekday("ts").alias("week_day"),
        arr.alias("arr_sod"),
        (arr + dwell).alias("dep_sod"),
        F.floor("value").alias("arrival_delay"),
        F.floor(F.col("value") / 2).alias("departure_delay"),
        F.col("event_id"),
    )


def actuals_text(events: DataFrame) -> DataFrame:
    """Events rendered in the ';'-file layout (all text), for the real parser."""
    sched_a = F.date_trunc("minute", F.col("ts"))
    act_a = F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)"))
    sched_d = sched_a + F.expr("INTERVAL 1 MINUTE")
    act_d = F.col("ts") + F.make_dt_interval(secs=(F.floor(F.col("value") / 2) + 60).cast("decimal(18,6)"))
    et = F.col("event_type")
    return events.select(
        F.date_format("ts", "dd.MM.yyyy").alias("service_day"),
        F.concat(F.lit("T"), (F.col("user_id") % OBS_TRIPS).cast("string")).alias("trip_id"),
        F.lit("Bus").alias("transport_type"),
        F.col("user_id").cast("string").alias("line_id"),
        et.alias("stop"),
        F.when(et != "signup", F.date_format(sched_a, "dd.MM.yyyy HH:mm")).alias("arr_sched"),
        F.when(et != "signup", F.date_format(act_a, "dd.MM.yyyy HH:mm:ss")).alias("arr_actual"),
        F.when(et != "error", F.lit("GESCHAETZT")).otherwise(F.lit("PROGNOSE")).alias("arr_status"),
        F.when(et != "view", F.date_format(sched_d, "dd.MM.yyyy HH:mm")).alias("dep_sched"),
        F.when(et != "view", F.date_format(act_d, "dd.MM.yyyy HH:mm:ss")).alias("dep_actual"),
        F.when(et.isin("click", "purchase"), F.lit("GESCHAETZT")).otherwise(F.lit("")).alias("dep_status"),
        F.when((et == "signup") & (F.col("value") < 5), "true").otherwise("false").alias("pass_through"),
        F.when((et == "error") & (F.col("value") > 400), "true").otherwise("false").alias("cancelled"),
        F.lit("false").alias("extra_trip"),
    )


def ride_stop_name() -> F.Column:
    return F.concat(F.col("event_type"), F.lit("_"),
                    (F.floor(F.col("value") / 5).cast("int") % 4).cast("string"))


def rides(events: DataFrame) -> DataFrame:
    """Timetable edges: one run per (user, date), consecutive events → edges."""
    # the run's key follows from (user, date), and later steps read whole runs by it: events move once
    run = Window.partitionBy("user_id", "service_date", "trip_id", "day_start").orderBy("ts", "event_id")
    s = events.select(
        "event_id", "user_id", "value",
        F.to_date("ts").alias("service_date"),
        (F.col("user_id") * 1000 + F.dayofyear(F.to_date("ts"))).alias("trip_id"),
        F.weekday("ts").alias("day_start"),
        ride_stop_name().alias("stop"),
        F.unix_timestamp("ts").alias("t"),
        F.col("ts"),
    ).repartition("trip_id", "day_start")
    e = (s.withColumns({
            "arr_node": F.lead("stop").over(run),
            "t_next": F.lead("t").over(run),
            "v_next": F.lead("value").over(run)})
         .where(F.col("arr_node").isNotNull()))
    dur = F.col("t_next") - F.col("t")
    sod = F.col("t") - F.unix_timestamp(F.col("service_date").cast("timestamp_ntz"))
    e = e.select(
        F.col("event_id").alias("edge_id"),
        "trip_id",
        F.col("day_start"),
        F.col("stop").alias("dep_node"),
        F.col("arr_node"),
        (F.col("day_start") * DAY_S + sod).cast("int").alias("dep_sow"),
        (F.col("day_start") * DAY_S + sod + dur).cast("int").alias("arr_sow"),
        F.floor("v_next").alias("arrival_delay"),
    )
    return e.where((F.col("dep_node") != F.col("arr_node"))
                   & (F.col("arr_sow") - F.col("dep_sow") >= 0)
                   & (F.col("arr_sow") - F.col("dep_sow") < MAX_EDGE_S))


def jstops(events: DataFrame) -> DataFrame:
    k = F.floor(F.col("value") / 5).cast("int") % 4
    return (events.select(ride_stop_name().alias("stop"),
                          (F.lit(JSTOP_LON0) + F.lit(JSTOP_DLON) * k).alias("lon"),
                          (F.lit(JSTOP_LAT0) + F.lit(JSTOP_DLAT) * (F.ascii("event_type") - 97)).alias("lat"))
            .groupBy("stop").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat")))


def sstops(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_name").alias("stop"),
        F.col("s_suppkey").alias("station_id"),
        (F.lit(SSTOP_LON0) + (F.col("s_suppkey") % SSTOP_COLS) * SSTOP_STEP).alias("lon"),
        (F.lit(SSTOP_LAT0) + F.floor(F.col("s_suppkey") / SSTOP_COLS) * SSTOP_STEP).alias("lat"),
        F.col("s_nationkey").alias("height"),
    )


def exp_dists(events: DataFrame) -> DataFrame:
    return (events.select(ride_stop_name().alias("dist_id"), "value")
            .groupBy("dist_id")
            .agg(F.lit(1.0).alias("shape"), F.lit(0.0).alias("loc"), F.avg("value").alias("scale")))


def _user_ends(events: DataFrame) -> DataFrame:
    e = events.select("user_id", "event_id", "ts", ride_stop_name().alias("stop"),
                      (F.weekday("ts") * DAY_S + F.hour("ts") * 3600 + F.minute("ts") * 60
                       + F.floor(F.second("ts")).cast("int")).alias("sow"))
    first = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(
        F.min_by(F.struct("stop", "sow"), first).alias("f"),
        F.max_by(F.struct("stop", "sow"), first).alias("l"))


def plan_queries(events: DataFrame, mode: str, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One query per user: first stop → last stop, leaving at the first event
    ('depart') or arriving by the last event ('arrive')."""
    u = _user_ends(events)
    t = F.col("f.sow") if mode == "depart" else F.col("l.sow")
    return u.select(F.col("user_id").alias("query_id"), F.lit(mode).alias("mode"),
                    F.col("f.stop").alias("dep_node"), F.col("l.stop").alias("arr_node"),
                    t.cast("int").alias("t_sow"), F.lit(float(threshold)).alias("threshold"))


def iso_queries(events: DataFrame, range_s: int = ISO_RANGE_S,
                threshold: float = DEFAULT_THRESHOLD, mode: str = "depart") -> DataFrame:
    """One query per user: around the first event, or backward from the last one ('arrive')."""
    u = _user_ends(events)
    end = "f" if mode == "depart" else "l"
    return u.select(F.col("user_id").alias("query_id"), F.col(f"{end}.stop").alias("start_node"),
                    F.col(f"{end}.sow").cast("int").alias("t_sow"), F.lit(int(range_s)).alias("range_s"),
                    F.lit(float(threshold)).alias("threshold"))


# ---- the same views in DuckDB SQL (used inside oracle queries as CTEs) ----

SQL_OBS = f"""v_obs AS (
  SELECT user_id % {OBS_TRIPS} AS trip_id, event_type AS stop, CAST(ts AS DATE) AS service_date,
         isodow(ts) - 1 AS day_start, isodow(ts) - 1 AS week_day,
         CAST(floor(hour(ts) / 4) AS INTEGER) * {SLOT_S} + 60 * (ascii(event_type) - 97) AS arr_sod,
         CAST(floor(hour(ts) / 4) AS INTEGER) * {SLOT_S} + 60 * (ascii(event_type) - 97)
           + CASE WHEN event_type = 'purchase' THEN {PURCHASE_DWELL_S} ELSE {DWELL_S} END AS dep_sod,
         CAST(floor(value) AS BIGINT) AS arrival_delay,
         CAST(floor(value / 2) AS BIGINT) AS departure_delay, event_id
  FROM events)"""

SQL_RIDE_STOP = "event_type || '_' || CAST(CAST(floor(value / 5) AS INTEGER) % 4 AS VARCHAR)"

SQL_RIDES = f"""v_s AS (
  SELECT event_id, user_id, value, CAST(ts AS DATE) AS service_date, isodow(ts) - 1 AS day_start,
         {SQL_RIDE_STOP} AS stop, CAST(floor(epoch(ts)) AS BIGINT) AS t, ts
  FROM events),
v_e AS (
  SELECT *, lead(stop) OVER w AS arr_node, lead(t) OVER w AS t_next, lead(value) OVER w AS v_next
  FROM v_s WINDOW w AS (PARTITION BY user_id, service_date ORDER BY ts, event_id)),
v_rides AS (
  SELECT event_id AS edge_id, user_id * 1000 + dayofyear(service_date) AS trip_id, day_start,
         stop AS dep_node, arr_node,
         CAST(day_start * {DAY_S} + (t - CAST(epoch(CAST(service_date AS TIMESTAMP)) AS BIGINT)) AS INTEGER) AS dep_sow,
         CAST(day_start * {DAY_S} + (t - CAST(epoch(CAST(service_date AS TIMESTAMP)) AS BIGINT)) + (t_next - t) AS INTEGER) AS arr_sow,
         CAST(floor(v_next) AS BIGINT) AS arrival_delay
  FROM v_e
  WHERE arr_node IS NOT NULL AND stop <> arr_node AND t_next - t >= 0 AND t_next - t < {MAX_EDGE_S})"""

SQL_JSTOPS = f"""v_jstops AS (
  SELECT {SQL_RIDE_STOP} AS stop,
         min(CAST({JSTOP_LON0} AS DOUBLE) + CAST({JSTOP_DLON} AS DOUBLE) * (CAST(floor(value / 5) AS INTEGER) % 4)) AS lon,
         min(CAST({JSTOP_LAT0} AS DOUBLE) + CAST({JSTOP_DLAT} AS DOUBLE) * (ascii(event_type) - 97)) AS lat
  FROM events GROUP BY 1)"""

SQL_SSTOPS = f"""v_stops AS (
  SELECT s_name AS stop, s_suppkey AS station_id,
         CAST({SSTOP_LON0} AS DOUBLE) + (s_suppkey % {SSTOP_COLS}) * CAST({SSTOP_STEP} AS DOUBLE) AS lon,
         CAST({SSTOP_LAT0} AS DOUBLE) + floor(s_suppkey / {SSTOP_COLS}) * CAST({SSTOP_STEP} AS DOUBLE) AS lat,
         s_nationkey AS height
  FROM supplier)"""

SQL_EXP_DISTS = f"""v_dists AS (
  SELECT {SQL_RIDE_STOP} AS dist_id, 1.0 AS shape, 0.0 AS loc, avg(value) AS scale
  FROM events GROUP BY 1)"""

SQL_USER_ENDS = f"""v_ue AS (
  SELECT user_id,
         arg_min({SQL_RIDE_STOP}, (ts, event_id)) AS f_stop,
         arg_min((isodow(ts) - 1) * {DAY_S} + hour(ts) * 3600 + minute(ts) * 60 + second(ts), (ts, event_id)) AS f_sow,
         arg_max({SQL_RIDE_STOP}, (ts, event_id)) AS l_stop,
         arg_max((isodow(ts) - 1) * {DAY_S} + hour(ts) * 3600 + minute(ts) * 60 + second(ts), (ts, event_id)) AS l_sow
  FROM events GROUP BY user_id)"""


def with_views(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
