"""Registered queries over the driver's tables, with DuckDB oracle SQL.

Each entry maps a name to a Spark callable (spark, sf_dir) → DataFrame and,
where the operator is SQL-expressible, the equivalent DuckDB SQL over the
same parquet tables. Doubles are rounded to 6 digits and integers cast to
BIGINT on both sides, because the driver hashes values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitrisk.functions.geo import haversine_m, mercator_x, mercator_y
from transitrisk.functions.timeops import DAY_S, WEEK_S, hhmm_to_sod
from transitrisk.operators import clustering as C
from transitrisk.operators import delays as D
from transitrisk.operators import paths as PA
from transitrisk.operators import split_runs as SR
from transitrisk.operators import summaries as SU
from transitrisk.operators import timetable as TT
from transitrisk.operators import walks as WK
from transitrisk.operators.transfers import (SearchParams, in_horizon, orient_rides, rel_times,
                                              transfer_table)
from transitrisk.session import scratch_path
from transitrisk.sources import actuals as AC
from transitrisk.sources import dated as DT
from transitrisk.sources import stations as ST
from transitrisk.sources import testdata as V

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Fixed parameters of the registered queries.
MIN_SUPPORT = 5           # observations per edge needed at these data sizes
BAD_STOP = "purchase"     # the stop bridged over in anomalous runs
CENTRE_STOP = "Supplier#000000007"
CENTRE_RADIUS_M = 1000.0
TOP_N = 10
BUFFER_S = 120
CUTOFF = 0.99


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def bi(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# ------------------------------------------------------------------ helpers

def _events(spark, d):
    return V.table(spark, d, "events")


def _obs(spark, d):
    return V.obs(_events(spark, d))


def _pairs(spark, d):
    return TT.consecutive_pairs(TT.delay_stats(_obs(spark, d)))


def _edges(spark, d):
    return TT.valid_edges(_pairs(spark, d))


def _rides(spark, d):
    """Events timetable with path key, stretches and a delay law per arrival stop."""
    from transitrisk.plans.journeys import prepare_rides
    r = V.rides(_events(spark, d)).withColumn("dist_id", F.col("arr_node"))
    return prepare_rides(r)


def _grids(spark, d):
    return D.cdf_grids(V.exp_dists(_events(spark, d)))


def _direct_walks(spark, d):
    w = WK.walk_pairs(V.jstops(_events(spark, d)))
    return w.select("dep_node", "arr_node", "walk_s", F.lit(1).alias("hops"),
                    F.col("dep_node").alias("prev_node"))


# SQL building blocks shared by the oracles -------------------------------

SQL_STATS = """v_stats AS (
  SELECT trip_id, day_start, week_day, arr_sod, dep_sod, stop,
         avg(arrival_delay) AS mean_delay, stddev_samp(arrival_delay) AS std_delay,
         count(arrival_delay) AS num_delays, avg(departure_delay) AS mean_dep_delay
  FROM v_obs GROUP BY ALL)"""

_NEXT = ["stop", "week_day", "arr_sod", "dep_sod", "rel_day", "mean_delay", "std_delay", "num_delays"]
SQL_PAIRS = ("""v_p0 AS (SELECT *, (week_day - day_start + 7) % 7 AS rel_day FROM v_stats),
v_p1 AS (
  SELECT *, row_number() OVER w AS pos, """
             + ", ".join(f"lead({c}) OVER w AS l_{c}, first_value({c}) OVER wf AS f_{c}" for c in _NEXT)
             + """
  FROM v_p0
  WINDOW w AS (PARTITION BY trip_id, day_start ORDER BY rel_day, arr_sod, dep_sod, stop),
         wf AS (PARTITION BY trip_id, day_start ORDER BY rel_day, arr_sod, dep_sod, stop
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
v_pairs AS (
  SELECT trip_id, day_start, pos, l_stop IS NULL AS wrap, stop AS dep_node,
         coalesce(l_stop, f_stop) AS arr_node, week_day AS dep_day,
         coalesce(l_week_day, f_week_day) AS arr_day, dep_sod,
         coalesce(l_arr_sod, f_arr_sod) AS arr_sod, coalesce(l_dep_sod, f_dep_sod) AS arr_row_dep_sod,
         coalesce(l_rel_day, f_rel_day) - rel_day + CASE WHEN l_stop IS NULL THEN 7 ELSE 0 END AS day_offset,
         coalesce(l_mean_delay, f_mean_delay) AS mean_delay, coalesce(l_std_delay, f_std_delay) AS std_delay,
         coalesce(l_num_delays, f_num_delays) AS num_delays
  FROM v_p1),
v_pairs_d AS (
  SELECT *, (arr_sod - dep_sod) / 60.0 + 1440 * day_offset AS delta FROM v_pairs),
v_edges AS (
  SELECT * FROM v_pairs_d WHERE delta >= 0 AND delta < 180 AND dep_node <> arr_node)""")

SQL_OBS_BASE = V.with_views(V.SQL_OBS, SQL_STATS, SQL_PAIRS)

SQL_RIDE_PATHS = """v_rp AS (
  SELECT trip_id, day_start,
         list(dep_node ORDER BY (dep_sow - day_start * 86400 + 604800) % 604800, dep_node, arr_node)
           || [max({'t': (dep_sow - day_start * 86400 + 604800) % 604800, 'd': dep_node, 'a': arr_node}).a] AS path
  FROM v_rides GROUP BY trip_id, day_start),
v_r AS (SELECT v_rides.*, v_rp.path, v_rides.arr_node AS dist_id FROM v_rides JOIN v_rp USING (trip_id, day_start))"""

SQL_HAV = ("2 * 6371000.0 * atan2(sqrt(pow(sin((radians({la2}) - radians({la1})) / 2), 2) + "
           "cos(radians({la1})) * cos(radians({la2})) * pow(sin((radians({lo2}) - radians({lo1})) / 2), 2)), "
           "sqrt(1 - (pow(sin((radians({la2}) - radians({la1})) / 2), 2) + "
           "cos(radians({la1})) * cos(radians({la2})) * pow(sin((radians({lo2}) - radians({lo1})) / 2), 2))))")


def hav_sql(la1, lo1, la2, lo2):
    return SQL_HAV.format(la1=la1, lo1=lo1, la2=la2, lo2=lo2)


SQL_JWALKS = f"""v_jw AS (
  SELECT a.stop AS dep_node, b.stop AS arr_node,
         {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS metres
  FROM v_jstops a JOIN v_jstops b ON a.stop <> b.stop),
v_walks AS (SELECT dep_node, arr_node, metres, CAST(ceil(metres / 1.0) AS INTEGER) AS walk_s
            FROM v_jw WHERE metres <= 500.0)"""

SQL_EXP_P = "CASE WHEN {s} <= 0 THEN 0.0 ELSE 1 - exp(-({s}) / d.scale) END"

# ------------------------------------------------------------ S1, S2, P6, F17


@register("station_line_parse", V.with_views(V.SQL_SSTOPS) + """
SELECT stop, round(lon, 6) AS lon, round(lat, 6) AS lat, CAST(station_id AS BIGINT) AS station_id,
       CAST(height AS BIGINT) AS height FROM v_stops""")
def q_station_line_parse(spark, d):
    lines = ST.format_station_lines(V.sstops(V.table(spark, d, "supplier")))
    p = ST.parse_station_lines(lines)
    return p.select("stop", r6("lon").alias("lon"), r6("lat").alias("lat"),
                    bi("station_id").alias("station_id"), bi("height").alias("height"))


@register("radius_filter", V.with_views(V.SQL_SSTOPS, f"""c AS (
  SELECT avg(lat) AS clat, avg(lon) AS clon FROM v_stops WHERE stop = '{CENTRE_STOP}')""") + f"""
SELECT stop, round(m, 6) AS centre_m FROM (
  SELECT stop, {hav_sql('c.clat', 'c.clon', 'lat', 'lon')} AS m FROM v_stops, c) t
WHERE m <= {CENTRE_RADIUS_M}""")
def q_radius_filter(spark, d):
    s = ST.within_radius(V.sstops(V.table(spark, d, "supplier")), CENTRE_STOP, CENTRE_RADIUS_M)
    return s.select("stop", r6("centre_m").alias("centre_m"))


@register("mercator", V.with_views(V.SQL_SSTOPS) + """
SELECT stop, round(6378137.0 * radians(lon), 6) AS x,
       round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 6) AS y FROM v_stops""")
def q_mercator(spark, d):
    s = V.sstops(V.table(spark, d, "supplier"))
    return s.select("stop", r6(mercator_x("lon")).alias("x"), r6(mercator_y("lat")).alias("y"))


# ------------------------------------------------------------ S3, P1-P5, F2-F9

@register("projected_obs", """
WITH e AS (
  SELECT *, date_trunc('minute', ts) AS tm FROM events WHERE event_type <> 'error'
    AND NOT (event_type = 'signup' AND value < 5)),
t AS (
  SELECT *, CASE WHEN event_type <> 'signup' THEN tm ELSE tm + INTERVAL 1 MINUTE END AS arr_t,
            CASE WHEN event_type <> 'view' THEN tm + INTERVAL 1 MINUTE ELSE tm END AS dep_t
  FROM e)
SELECT 'T' || CAST(user_id % 5 AS VARCHAR) AS trip_id, event_type AS stop,
       CAST(ts AS DATE) AS service_date, CAST(isodow(ts) - 1 AS BIGINT) AS day_start,
       CAST(isodow(arr_t) - 1 AS BIGINT) AS week_day,
       CAST(hour(arr_t) * 3600 + minute(arr_t) * 60 AS BIGINT) AS arr_sod,
       CAST(hour(dep_t) * 3600 + minute(dep_t) * 60 + 86400 * (CAST(dep_t AS DATE) - CAST(arr_t AS DATE)) AS BIGINT) AS dep_sod,
       CASE WHEN event_type <> 'signup' THEN CAST(second(ts) + floor(value) AS BIGINT) END AS arrival_delay,
       CASE WHEN event_type IN ('click', 'purchase') THEN CAST(second(ts) + floor(value / 2) AS BIGINT) END AS departure_delay
FROM t""")
def q_projected_obs(spark, d):
    o = AC.normalize_actuals(V.actuals_text(_events(spark, d)))
    return o.select("trip_id", "stop", "service_date", bi("day_start").alias("day_start"),
                    bi("week_day").alias("week_day"), bi("arr_sod").alias("arr_sod"),
                    bi("dep_sod").alias("dep_sod"), bi("arrival_delay").alias("arrival_delay"),
                    bi("departure_delay").alias("departure_delay"))


@register("dated_store", ORACLE["projected_obs"].replace("SELECT 'T'", "SELECT service_date, count(*) AS n_rows, "
          "count(arrival_delay) AS n_arrival, CAST(sum(arrival_delay) AS BIGINT) AS sum_arrival FROM (SELECT 'T'")
          + ") o GROUP BY service_date")
def q_dated_store(spark, d):
    """The actuals as one file a day, loaded in two goes (the second finds all files
    and opens the new ones only), read back from the dated store."""
    base = scratch_path(spark, "dated")
    text = V.actuals_text(_events(spark, d)).withColumn("day", F.substring("service_day", 1, 2).cast("int"))
    for half, some in (("a", F.col("day") % 2 == 0), ("b", F.col("day") % 2 == 1)):
        (text.where(some).withColumnsRenamed({v: k for k, v in AC.ACTUALS_COLUMNS.items()})
         .repartition("day").write.option("sep", ";").option("header", True).partitionBy("day").csv(f"{base}/in/{half}"))
    DT.load_new_days(spark, f"{base}/in/a/day=*/*.csv", f"{base}/store")
    DT.load_new_days(spark, f"{base}/in/*/day=*/*.csv", f"{base}/store")
    o = DT.read_days(spark, f"{base}/store")
    return o.groupBy("service_date").agg(F.count(F.lit(1)).alias("n_rows"), F.count("arrival_delay").alias("n_arrival"),
                                         bi(F.sum("arrival_delay")).alias("sum_arrival"))


@register("weekday_coalesce", """
SELECT event_id, CAST(isodow(ts) - 1 AS BIGINT) AS week_day, CAST(ts AS DATE) AS service_date,
       round(coalesce(CASE WHEN event_type <> 'signup' THEN value END, value * 2), 6) AS filled,
       CAST(coalesce(CASE WHEN event_type <> 'error' THEN floor(value) END, 0) AS BIGINT) AS zero_filled
FROM events""")
def q_weekday_coalesce(spark, d):
    e = _events(spark, d)
    day = F.try_to_date(F.date_format("ts", "dd.MM.yyyy"), "dd.MM.yyyy")
    return e.select("event_id", bi(F.weekday(day)).alias("week_day"), day.alias("service_date"),
                    r6(F.coalesce(F.when(F.col("event_type") != "signup", F.col("value")),
                                  F.col("value") * 2)).alias("filled"),
                    bi(F.coalesce(F.when(F.col("event_type") != "error", F.floor("value")), F.lit(0)))
                    .alias("zero_filled"))


@register("timestamp_delay", """
SELECT event_id, CAST(second(ts) + floor(value) AS BIGINT) AS delay_s,
       CAST(hour(ts) * 3600 + minute(ts) * 60 AS BIGINT) AS sched_sod FROM events""")
def q_timestamp_delay(spark, d):
    e = _events(spark, d)
    sched = F.date_format(F.date_trunc("minute", "ts"), "dd.MM.yyyy HH:mm")
    actual = F.date_format(F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)")),
                           "dd.MM.yyyy HH:mm:ss")
    delay = (F.unix_timestamp(F.try_to_timestamp(actual, F.lit(AC.ACTUAL_FMT)))
             - F.unix_timestamp(F.try_to_timestamp(sched, F.lit(AC.SCHED_FMT))))
    clock = F.get(F.split(sched, " "), 1)
    return e.select("event_id", bi(delay).alias("delay_s"), bi(hhmm_to_sod(clock)).alias("sched_sod"))


# ------------------------------------------------------------ A1-A5, W1-W3, P7-P9

@register("obs_delay_stats", V.with_views(V.SQL_OBS, SQL_STATS) + """
SELECT CAST(trip_id AS BIGINT) AS trip_id, CAST(day_start AS BIGINT) AS day_start,
       CAST(week_day AS BIGINT) AS week_day, CAST(arr_sod AS BIGINT) AS arr_sod,
       CAST(dep_sod AS BIGINT) AS dep_sod, stop, round(mean_delay, 6) AS mean_delay,
       round(std_delay, 6) AS std_delay, CAST(num_delays AS BIGINT) AS num_delays,
       round(mean_dep_delay, 6) AS mean_dep_delay FROM v_stats""")
def q_obs_delay_stats(spark, d):
    s = TT.delay_stats(_obs(spark, d))
    return s.select(*[bi(c).alias(c) for c in ["trip_id", "day_start", "week_day", "arr_sod", "dep_sod"]],
                    "stop", r6("mean_delay").alias("mean_delay"), r6("std_delay").alias("std_delay"),
                    bi("num_delays").alias("num_delays"), r6("mean_dep_delay").alias("mean_dep_delay"))


EDGE_COLS = ["trip_id", "day_start", "dep_node", "arr_node", "dep_day", "arr_day", "dep_sod", "arr_sod",
             "delta", "mean_delay", "std_delay", "num_delays"]


def _edge_out(df):
    out = []
    for c in EDGE_COLS:
        if c in ("dep_node", "arr_node"):
            out.append(F.col(c))
        elif c in ("delta", "mean_delay", "std_delay"):
            out.append(r6(c).alias(c))
        else:
            out.append(bi(c).alias(c))
    return df.select(*out)


def _edge_sql(src):
    cols = []
    for c in EDGE_COLS:
        if c in ("dep_node", "arr_node"):
            cols.append(c)
        elif c in ("delta", "mean_delay", "std_delay"):
            cols.append(f"round({c}, 6) AS {c}")
        else:
            cols.append(f"CAST({c} AS BIGINT) AS {c}")
    return f"SELECT {', '.join(cols)} FROM {src}"


@register("consecutive_edges", SQL_OBS_BASE + _edge_sql("v_edges"))
def q_consecutive_edges(spark, d):
    return _edge_out(_edges(spark, d))


@register("wraparound_edges", SQL_OBS_BASE + _edge_sql("v_pairs_d WHERE wrap"))
def q_wraparound_edges(spark, d):
    return _edge_out(_pairs(spark, d).where("wrap"))


@register("edge_duration", SQL_OBS_BASE + """
SELECT CAST(trip_id AS BIGINT) AS trip_id, CAST(day_start AS BIGINT) AS day_start, CAST(pos AS BIGINT) AS pos,
       CAST(day_offset AS BIGINT) AS day_offset, round(delta, 6) AS delta FROM v_pairs_d""")
def q_edge_duration(spark, d):
    p = _pairs(spark, d)
    return p.select(bi("trip_id").alias("trip_id"), bi("day_start").alias("day_start"), bi("pos").alias("pos"),
                    bi("day_offset").alias("day_offset"), r6("delta").alias("delta"))


_BR_COLS = ["arr_node", "arr_day", "arr_sod", "arr_row_dep_sod", "mean_delay", "std_delay", "num_delays"]
SQL_BRIDGE = (SQL_OBS_BASE.rstrip() + f""",
v_b0 AS (
  SELECT *, max(CASE WHEN dep_day = arr_day AND dep_sod > arr_sod AND NOT wrap THEN 1 ELSE 0 END)
              OVER (PARTITION BY trip_id, day_start) AS bad_run,
         lead(pos) OVER wp AS n_pos, """
              + ", ".join(f"lead({c}) OVER wp AS n_{c}" for c in _BR_COLS) + f"""
  FROM v_pairs WINDOW wp AS (PARTITION BY trip_id, day_start ORDER BY pos)),
v_b1 AS (
  SELECT trip_id, day_start, pos, wrap, dep_node, dep_day, dep_sod, """
              + ", ".join(f"CASE WHEN bad_run = 1 AND arr_node = '{BAD_STOP}' AND n_pos IS NOT NULL "
                          f"THEN n_{c} ELSE {c} END AS {c}" for c in _BR_COLS) + f"""
  FROM v_b0 WHERE NOT (bad_run = 1 AND dep_node = '{BAD_STOP}')),
v_b2 AS (
  SELECT *, (arr_sod - dep_sod) / 60.0 + 1440 * (((arr_day - dep_day) % 7 + 7) % 7
            + CASE WHEN wrap THEN 7 ELSE 0 END) AS delta FROM v_b1)
""" + _edge_sql("v_b2 WHERE delta >= 0 AND delta < 180 AND dep_node <> arr_node"))


@register("bridge_repair", SQL_BRIDGE)
def q_bridge_repair(spark, d):
    return _edge_out(TT.valid_edges(TT.bridge_repair(_pairs(spark, d), BAD_STOP)))


@register("trip_pool", V.with_views(V.SQL_OBS) + """
SELECT CAST(trip_id AS BIGINT) AS trip_id, count(*) AS n_rows, count(DISTINCT stop) AS n_stops,
       count(DISTINCT week_day) AS n_days FROM v_obs GROUP BY trip_id""")
def q_trip_pool(spark, d):
    t = TT.trip_pool(_obs(spark, d))
    return t.select(bi("trip_id").alias("trip_id"), bi("n_rows").alias("n_rows"),
                    bi("n_stops").alias("n_stops"), bi("n_days").alias("n_days"))


@register("top_edges", SQL_OBS_BASE + _edge_sql(
    f"(SELECT * FROM v_edges ORDER BY num_delays DESC, trip_id, day_start, dep_day, dep_sod, dep_node, arr_node "
    f"LIMIT {TOP_N}) t"))
def q_top_edges(spark, d):
    return _edge_out(TT.top_edges(_edges(spark, d), TOP_N))


@register("support_filter", SQL_OBS_BASE + _edge_sql(f"v_edges WHERE num_delays >= {MIN_SUPPORT}"))
def q_support_filter(spark, d):
    return _edge_out(TT.support_filter(_edges(spark, d), MIN_SUPPORT))


@register("support_summary", SQL_OBS_BASE + """
SELECT count(num_delays) AS n, round(avg(num_delays), 6) AS mean, round(stddev_samp(num_delays), 6) AS std,
       round(min(num_delays), 6) AS min, round(quantile_cont(num_delays, 0.25), 6) AS q25,
       round(quantile_cont(num_delays, 0.5), 6) AS q50, round(quantile_cont(num_delays, 0.75), 6) AS q75,
       round(max(num_delays), 6) AS max FROM v_edges""")
def q_support_summary(spark, d):
    s = TT.support_summary(_edges(spark, d))
    return s.select(bi("n").alias("n"), *[r6(c).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


# ------------------------------------------------------------ A6, A7, J3

SQL_OBS_PATHS = (SQL_OBS_BASE.rstrip() + """,
v_ep AS (SELECT *, dep_day * 86400 + dep_sod AS dep_sow FROM v_edges),
v_paths AS (
  SELECT trip_id, day_start,
         list(dep_node ORDER BY (dep_sow - day_start * 86400 + 604800) % 604800, dep_node, arr_node)
           || [max({'t': (dep_sow - day_start * 86400 + 604800) % 604800, 'd': dep_node, 'a': arr_node}).a] AS path
  FROM v_ep GROUP BY trip_id, day_start)
""")


def _obs_paths(spark, d):
    e = _edges(spark, d).withColumn("dep_sow", F.col("dep_day") * DAY_S + F.col("dep_sod"))
    return e, PA.run_paths(e)


@register("trip_paths", SQL_OBS_PATHS + """
SELECT CAST(trip_id AS BIGINT) AS trip_id, CAST(day_start AS BIGINT) AS day_start,
       array_to_string(path, '>') AS path, CAST(len(path) AS BIGINT) AS n_stops FROM v_paths""")
def q_trip_paths(spark, d):
    _, p = _obs_paths(spark, d)
    return p.select(bi("trip_id").alias("trip_id"), bi("day_start").alias("day_start"),
                    F.array_join("path", ">").alias("path"), bi("n_stops").alias("n_stops"))


@register("path_join", SQL_OBS_PATHS + """
SELECT CAST(e.trip_id AS BIGINT) AS trip_id, CAST(e.day_start AS BIGINT) AS day_start, e.dep_node, e.arr_node,
       CAST(e.dep_sow AS BIGINT) AS dep_sow, array_to_string(p.path, '>') AS path
FROM v_ep e LEFT JOIN v_paths p USING (trip_id, day_start)""")
def q_path_join(spark, d):
    e, p = _obs_paths(spark, d)
    j = PA.attach_path_id(e, p).join(p.select("path_id", "path").dropDuplicates(["path_id"]), "path_id", "left")
    return j.select(bi("trip_id").alias("trip_id"), bi("day_start").alias("day_start"), "dep_node", "arr_node",
                    bi("dep_sow").alias("dep_sow"), F.array_join("path", ">").alias("path"))


@register("path_dictionary", V.with_views(V.SQL_RIDES, SQL_RIDE_PATHS) + """
SELECT array_to_string(path, '>') AS path, CAST(dense_rank() OVER (ORDER BY path) - 1 AS BIGINT) AS path_no,
       count(*) AS n_runs FROM v_rp GROUP BY v_rp.path""")
def q_path_dictionary(spark, d):
    """Every distinct stop list of the rides' runs with its exact number, and how many runs share it."""
    p = PA.run_paths(V.rides(_events(spark, d)))
    numbered = PA.exact_path_ids(p, PA.path_dictionary(p))
    return (numbered.groupBy("path", "path_id").agg(F.count(F.lit(1)).alias("n_runs"))
            .select(F.array_join("path", ">").alias("path"), bi("path_id").alias("path_no"), bi("n_runs").alias("n_runs")))


@register("split_run_edges", SQL_BRIDGE)
def q_split_run_edges(spark, d):
    """Pairs, wrap-around and bridge repair by blocks of a run's time."""
    pairs = SR.consecutive_pairs(TT.delay_stats(_obs(spark, d)))
    return _edge_out(TT.valid_edges(SR.bridge_repair(pairs, BAD_STOP)))


@register("split_run_segments", V.with_views(V.SQL_RIDES) + """
SELECT edge_id, CAST(trip_id AS BIGINT) AS trip_id, CAST(day_start AS BIGINT) AS day_start,
       CAST(sum(brk) OVER (PARTITION BY trip_id, day_start ORDER BY dep_sow, edge_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg,
       row_number() OVER (PARTITION BY trip_id, day_start ORDER BY dep_sow, edge_id) AS seq
FROM (SELECT *, CASE WHEN lag(arr_node) OVER w <> dep_node OR lag(arr_sow) OVER w > dep_sow THEN 1 ELSE 0 END AS brk
      FROM v_rides WINDOW w AS (PARTITION BY trip_id, day_start ORDER BY dep_sow, edge_id)) r""")
def q_split_run_segments(spark, d):
    """Connected stretches of every run by blocks of departure time."""
    s = SR.chain_segments(V.rides(_events(spark, d)))
    return s.select(bi("edge_id").alias("edge_id"), bi("trip_id").alias("trip_id"), bi("day_start").alias("day_start"),
                    bi("seg").alias("seg"), bi("seq").alias("seq"))


# ------------------------------------------------------------ J1, J2, J4, J5, U2, U3, O4, F10

@register("stop_semi_join", V.with_views(V.SQL_RIDES, V.SQL_JSTOPS) + """
SELECT stop, round(lon, 6) AS lon, round(lat, 6) AS lat FROM v_jstops s
WHERE EXISTS (SELECT 1 FROM v_rides r WHERE r.dep_node = s.stop OR r.arr_node = s.stop)""")
def q_stop_semi_join(spark, d):
    e = _events(spark, d)
    s = WK.stops_in_timetable(V.jstops(e), V.rides(e))
    return s.select("stop", r6("lon").alias("lon"), r6("lat").alias("lat"))


@register("obs_known_stops", V.with_views(V.SQL_OBS, V.SQL_RIDES) + """
SELECT event_id, stop FROM v_obs o
WHERE EXISTS (SELECT 1 FROM v_rides r WHERE split_part(r.dep_node, '_', 1) = o.stop)""")
def q_obs_known_stops(spark, d):
    e = _events(spark, d)
    known = V.rides(e).select(F.split("dep_node", "_").getItem(0).alias("stop")).distinct()
    return WK.observations_at_known_stops(V.obs(e), known).select("event_id", "stop")


@register("stop_union", V.with_views(V.SQL_RIDES) + """
SELECT dep_node AS stop FROM v_rides UNION SELECT arr_node FROM v_rides""")
def q_stop_union(spark, d):
    return WK.timetable_stops(V.rides(_events(spark, d)))


@register("walk_pairs", V.with_views(V.SQL_SSTOPS) + f"""
SELECT dep_node, arr_node, round(metres, 6) AS metres, CAST(ceil(metres) AS BIGINT) AS walk_s FROM (
  SELECT a.stop AS dep_node, b.stop AS arr_node, {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS metres
  FROM v_stops a JOIN v_stops b ON a.stop <> b.stop) t WHERE metres <= 500.0""")
def q_walk_pairs(spark, d):
    w = WK.walk_pairs(V.sstops(V.table(spark, d, "supplier")))
    return w.select("dep_node", "arr_node", r6("metres").alias("metres"), bi("walk_s").alias("walk_s"))


@register("distance_pairs", V.with_views(V.SQL_RIDES, V.SQL_JSTOPS) + f"""
SELECT p.dep_node, p.arr_node, round({hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS metres
FROM (SELECT DISTINCT dep_node, arr_node FROM v_rides) p
JOIN v_jstops a ON a.stop = p.dep_node JOIN v_jstops b ON b.stop = p.arr_node""")
def q_distance_pairs(spark, d):
    e = _events(spark, d)
    r = WK.connected_pair_distances(V.rides(e), V.jstops(e))
    return r.select("dep_node", "arr_node", r6("metres").alias("metres"))


@register("rides_and_walks", V.with_views(V.SQL_RIDES, V.SQL_JSTOPS, SQL_JWALKS) + """
SELECT 'ride' AS kind, dep_node, arr_node, CAST(dep_sow AS BIGINT) AS dep_sow, CAST(arr_sow AS BIGINT) AS arr_sow,
       CAST(NULL AS BIGINT) AS walk_s FROM v_rides
UNION ALL
SELECT 'walk', dep_node, arr_node, NULL, NULL, CAST(walk_s AS BIGINT) FROM v_walks""")
def q_rides_and_walks(spark, d):
    e = _events(spark, d)
    u = WK.rides_and_walks(V.rides(e).select("dep_node", "arr_node", "dep_sow", "arr_sow"),
                           WK.walk_pairs(V.jstops(e)).select("dep_node", "arr_node", "walk_s"))
    return u.select("kind", "dep_node", "arr_node", bi("dep_sow").alias("dep_sow"), bi("arr_sow").alias("arr_sow"),
                    bi("walk_s").alias("walk_s"))


# ------------------------------------------------------------ A8, A9-A12, F12, F13, M1-M4, O6

_GK = ["trip_id", "day_start", "week_day", "arr_sod", "dep_sod", "stop"]


@register("delay_percentiles", V.with_views(V.SQL_OBS) + """
SELECT CAST(trip_id AS BIGINT) AS trip_id, CAST(day_start AS BIGINT) AS day_start, CAST(week_day AS BIGINT) AS week_day,
       CAST(arr_sod AS BIGINT) AS arr_sod, CAST(dep_sod AS BIGINT) AS dep_sod, stop, CAST(n AS BIGINT) AS n, """
          + ", ".join(f"round(q[{i + 1}], 6) AS p{p}" for i, p in enumerate(D.PERCENTILES)) + """
FROM (SELECT trip_id, day_start, week_day, arr_sod, dep_sod, stop, count(arrival_delay) AS n,
             quantile_cont(arrival_delay, [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) AS q
      FROM v_obs GROUP BY ALL) t""")
def q_delay_percentiles(spark, d):
    p = D.delay_percentiles(_obs(spark, d), _GK, "arrival_delay")
    return p.select(*[bi(c).alias(c) if c != "stop" else F.col(c) for c in _GK], bi("n").alias("n"),
                    *[r6(c).alias(c) for c in D.FEATURE_COLS])


@register("delay_histogram", V.with_views(V.SQL_OBS) + """
, r AS (SELECT stop, min(arrival_delay) AS lo, max(arrival_delay) AS hi, count(arrival_delay) AS n FROM v_obs GROUP BY stop),
h AS (
  SELECT o.stop, CASE WHEN r.hi > r.lo THEN least(floor((CAST(o.arrival_delay AS DOUBLE) - r.lo) / CAST(r.hi - r.lo AS DOUBLE) * 100) + 1, 100)
                      ELSE 1 END AS bin, r.lo, r.hi, r.n
  FROM v_obs o JOIN r USING (stop))
SELECT stop, CAST(bin AS BIGINT) AS bin, count(*) AS cnt,
       round(count(*) / (n * CASE WHEN hi > lo THEN CAST(hi - lo AS DOUBLE) / 100 ELSE 1.0 END), 6) AS density
FROM h GROUP BY stop, bin, lo, hi, n""")
def q_delay_histogram(spark, d):
    h = D.delay_histogram(_obs(spark, d).select("stop", F.col("arrival_delay").alias("delay")), "stop")
    return h.select("stop", bi("bin").alias("bin"), bi("cnt").alias("cnt"), r6("density").alias("density"))


@register("gamma_stats", V.with_views(V.SQL_OBS) + """
, m AS (SELECT stop, min(arrival_delay) AS x_min FROM v_obs GROUP BY stop)
SELECT stop, CAST(x_min AS BIGINT) AS x_min, round(x_min - 1e-10, 6) AS loc, count(*) AS n,
       round(avg(arrival_delay - (x_min - 1e-10)), 6) AS mean_shift,
       round(avg(ln(arrival_delay - (x_min - 1e-10))), 6) AS mean_log,
       round(var_samp(arrival_delay), 6) AS var
FROM v_obs JOIN m USING (stop) GROUP BY stop, x_min""")
def q_gamma_stats(spark, d):
    s = D.gamma_stats(_obs(spark, d).select("stop", F.col("arrival_delay").alias("delay")), "stop")
    return s.select("stop", bi("x_min").alias("x_min"), r6("loc").alias("loc"), bi("n").alias("n"),
                    r6("mean_shift").alias("mean_shift"), r6("mean_log").alias("mean_log"), r6("var").alias("var"))


# The maximum-likelihood shape in SQL: bisection on ln(a) - digamma(a) = ln(mean) - mean(ln), the
# digamma by its recurrence up to a + 8 and its asymptotic series there.
def _digamma_sql(a: str) -> str:
    y = f"({a} + 8)"
    steps = " - ".join(f"1 / ({a} + {i})" for i in range(8))
    return (f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6))"
            f" + 1 / (240 * pow({y}, 8)) - {steps})")


SQL_STOP_FITS = V.with_views(V.SQL_OBS).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
m AS (SELECT stop, min(arrival_delay) AS x_min, max(arrival_delay) AS x_max FROM v_obs GROUP BY stop),
st AS (SELECT stop, x_min, x_max, x_min - CAST(1e-10 AS DOUBLE) AS loc, count(*) AS n,
              avg(arrival_delay - (x_min - CAST(1e-10 AS DOUBLE))) AS mean_shift,
              avg(ln(arrival_delay - (x_min - CAST(1e-10 AS DOUBLE)))) AS mean_log
       FROM v_obs JOIN m USING (stop) GROUP BY stop, x_min, x_max),
it AS (
  SELECT stop, ln(mean_shift) - mean_log AS s, CAST(-20 AS DOUBLE) AS lo, CAST(20 AS DOUBLE) AS hi, 0 AS k FROM st
  UNION ALL
  SELECT stop, s, CASE WHEN g > s THEN (lo + hi) / 2 ELSE lo END, CASE WHEN g > s THEN hi ELSE (lo + hi) / 2 END, k + 1
  FROM (SELECT *, (lo + hi) / 2 - {_digamma_sql('exp((lo + hi) / 2)')} AS g FROM it) WHERE k < 70),
fit AS (SELECT st.*, exp((lo + hi) / 2) AS shape, mean_shift / exp((lo + hi) / 2) AS scale
        FROM st JOIN it USING (stop) WHERE k = 70)
"""


def _stop_fits(spark, d):
    long = _obs(spark, d).select("stop", F.col("arrival_delay").alias("delay"))
    st = D.gamma_stats(long, "stop")
    mx = long.groupBy("stop").agg(F.max("delay").alias("x_max"))
    return D.fit_gamma(st).join(mx, "stop")


@register("gamma_fit", SQL_STOP_FITS + """
SELECT stop, 'mle' AS method, round(shape, 6) AS shape, round(loc, 6) AS loc, round(scale, 6) AS scale, n FROM fit""")
def q_gamma_fit(spark, d):
    f = _stop_fits(spark, d)
    return f.select("stop", "method", r6("shape").alias("shape"), r6("loc").alias("loc"),
                    r6("scale").alias("scale"), bi("n").alias("n"))


@register("gamma_pdf_curve", SQL_STOP_FITS.rstrip() + f""",
p AS (SELECT *, x_min + (x_max - x_min) * i / ({D.PDF_POINTS} - 1.0) AS x FROM fit, range({D.PDF_POINTS}) AS r(i))
SELECT stop, i, round(x, 6) AS x, round(CASE WHEN x > loc THEN
         exp((shape - 1) * ln((x - loc) / scale) - (x - loc) / scale - lgamma(shape)) / scale ELSE 0 END, 6) AS pdf FROM p""")
def q_gamma_pdf_curve(spark, d):
    c = D.gamma_pdf_curve(_stop_fits(spark, d), "stop")
    return c.select("stop", bi("i").alias("i"), r6("x").alias("x"), r6("pdf").alias("pdf"))


@register("gamma_cdf_erlang", V.with_views(V.SQL_EXP_DISTS) + """
, k AS (SELECT dist_id, 1 + ascii(dist_id) % 3 AS shape, scale FROM v_dists),
x AS (SELECT dist_id, shape, scale, unnest([60.0, 120.0, 300.0]) AS at_s FROM k)
SELECT dist_id, CAST(shape AS BIGINT) AS shape, round(at_s, 6) AS at_s,
       round(1 - exp(-at_s / scale) * (1 + CASE WHEN shape >= 2 THEN at_s / scale ELSE 0 END
                                          + CASE WHEN shape >= 3 THEN pow(at_s / scale, 2) / 2 ELSE 0 END), 6) AS cdf
FROM x""")
def q_gamma_cdf_erlang(spark, d):
    k = V.exp_dists(_events(spark, d)).withColumn("shape", (1 + F.ascii("dist_id") % 3).cast("double"))
    x = k.withColumn("at_s", F.explode(F.array(F.lit(60.0), F.lit(120.0), F.lit(300.0))))
    cdf = D.gamma_cdf_udf(F.col("at_s"), F.col("shape"), F.col("loc"), F.col("scale"))
    return x.select("dist_id", bi("shape").alias("shape"), r6("at_s").alias("at_s"), r6(cdf).alias("cdf"))


@register("reliability_300s", V.with_views(V.SQL_EXP_DISTS) + """
SELECT dist_id, round(1 - exp(-300.0 / scale), 6) AS cdf FROM v_dists""")
def q_reliability_300s(spark, d):
    dists = V.exp_dists(_events(spark, d)).withColumn("method", F.lit("mle"))
    return D.cdf_at(dists.withColumnRenamed("dist_id", "key"), "key", 300.0) \
        .select(F.col("key").alias("dist_id"), r6("cdf").alias("cdf"))


@register("reliability_summary", V.with_views(V.SQL_EXP_DISTS) + """
, c AS (SELECT CAST(round((1 - exp(-300.0 / scale)) * 1000000) AS BIGINT) AS cdf_micro FROM v_dists)
SELECT count(cdf_micro) AS n, round(avg(cdf_micro) / 1e6, 6) AS mean, round(stddev_samp(cdf_micro) / 1e6, 6) AS std,
       round(min(cdf_micro) / 1e6, 6) AS min, round(quantile_cont(cdf_micro, 0.25) / 1e6, 6) AS q25,
       round(quantile_cont(cdf_micro, 0.5) / 1e6, 6) AS q50, round(quantile_cont(cdf_micro, 0.75) / 1e6, 6) AS q75,
       round(max(cdf_micro) / 1e6, 6) AS max FROM c""")
def q_reliability_summary(spark, d):
    """A5 over CDF(300 s) per law, in exact integer micro-units."""
    r = q_reliability_300s(spark, d).select(F.round(F.col("cdf") * 1e6).cast("bigint").alias("cdf_micro"))
    s = TT.support_summary(r, "cdf_micro")
    return s.select(bi("n").alias("n"),
                    *[r6(F.col(c) / 1e6).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


def _features(spark, d):
    obs = _obs(spark, d)
    p = D.delay_percentiles(obs, _GK, "arrival_delay").where(F.col("n") >= MIN_SUPPORT)
    return C.features(p)


@register("kmeans_labels")
def q_kmeans_labels(spark, d):
    f = _features(spark, d)
    lab = C.cluster_labels(f, C.K_CHOSEN)
    return lab.select(*[bi(c).alias(c) if c != "stop" else F.col(c) for c in _GK], bi("cluster").alias("cluster"))


@register("kmeans_sweep")
def q_kmeans_sweep(spark, d):
    return C.kmeans_sweep(_features(spark, d))


@register("cluster_sample")
def q_cluster_sample(spark, d):
    f = _features(spark, d)
    lab = C.cluster_labels(f, C.K_CHOSEN)
    return C.cluster_sample(lab)


@register("cluster_gamma")
def q_cluster_gamma(spark, d):
    """A9-A10 on the KMeans clusters: pooled delays per cluster → gamma fit."""
    f = _features(spark, d)
    lab = C.cluster_labels(f, C.K_CHOSEN).select(*_GK, "cluster")
    long = _obs(spark, d).join(lab, _GK).select("cluster", F.col("arrival_delay").alias("delay"))
    fit = D.fit_gamma(D.gamma_stats(long, "cluster"))
    return fit.select(bi("cluster").alias("cluster"), "method", r6("shape").alias("shape"),
                      r6("loc").alias("loc"), r6("scale").alias("scale"), bi("n").alias("n"))


# ------------------------------------------------------------ journeys: P12-P17, J11-J13, W4, W5, F14, G1-G9

_TIMETABLES: dict[tuple[str, str], object] = {}


def _stamps(spark, df):
    """Paths, lengths and times of a table's files: a changed folder is another timetable."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        s = path.getFileSystem(conf).getFileStatus(path)
        yield f, s.getLen(), s.getModificationTime()


def _ride_timetable(spark, d):
    """Journey timetable of a data folder, built once per application and
    stored as Parquet in the shared checkpoint folder (S4), then read back
    (S5) by every plan/isochrone query."""
    from transitrisk.plans.journeys import build_timetable
    e = _events(spark, d)
    key = (spark.sparkContext.applicationId, d, tuple(_stamps(spark, e)))
    if key not in _TIMETABLES:
        _TIMETABLES[key] = build_timetable(spark, _rides(spark, d), V.jstops(e), V.exp_dists(e))
    return _TIMETABLES[key]


def _depart_q(spark, d):
    q = V.plan_queries(_events(spark, d), "depart")
    return q.select("query_id", F.col("t_sow").alias("T"), F.col("dep_node").alias("start"),
                    F.col("arr_node").alias("target"), "threshold")


SQL_RIDES_FULL = V.with_views(V.SQL_RIDES, SQL_RIDE_PATHS, V.SQL_EXP_DISTS, V.SQL_USER_ENDS)

SQL_HORIZON = SQL_RIDES_FULL.rstrip() + f""",
q AS (SELECT user_id AS query_id, f_stop AS start, l_stop AS target, CAST(f_sow AS BIGINT) AS T FROM v_ue),
h AS (
  SELECT q.query_id, q.T, q.target, r.*,
         ((r.dep_sow - q.T) % {WEEK_S} + {WEEK_S}) % {WEEK_S} AS from_t
  FROM q JOIN v_r r ON r.dep_node = q.start),
hz AS (
  SELECT *, from_t + (arr_sow - dep_sow) AS to_t FROM h),
hh AS (
  SELECT * FROM hz WHERE from_t > 0 AND (from_t < {DAY_S} - T % {DAY_S} OR to_t < {DAY_S}))
"""


@register("horizon_edges", SQL_HORIZON + """
SELECT query_id, count(*) AS n_edges, CAST(min(from_t) AS BIGINT) AS first_from_t,
       CAST(max(to_t) AS BIGINT) AS last_to_t FROM hh GROUP BY query_id""")
def q_horizon_edges(spark, d):
    from transitrisk.operators.transfers import horizon_rides
    h = horizon_rides(_depart_q(spark, d), orient_rides(_rides(spark, d), "depart"), "depart")
    return h.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_edges"), bi(F.min("from_t")).alias("first_from_t"),
                                     bi(F.max("to_t")).alias("last_to_t"))


@register("horizon_edges_by_day", SQL_HORIZON + """
SELECT query_id, count(*) AS n_edges, CAST(min(from_t) AS BIGINT) AS first_from_t,
       CAST(max(to_t) AS BIGINT) AS last_to_t FROM hh GROUP BY query_id""")
def q_horizon_edges_by_day(spark, d):
    """Rides within each query's horizon, from rides stored by departure day."""
    from transitrisk.operators.transfers import horizon_rides
    path = DT.write_rides_by_day(_rides(spark, d), scratch_path(spark, "rides-by-day"))
    q = _depart_q(spark, d)
    h = horizon_rides(q, orient_rides(DT.rides_needed(spark, path, q, "depart"), "depart"), "depart")
    return h.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_edges"), bi(F.min("from_t")).alias("first_from_t"),
                                     bi(F.max("to_t")).alias("last_to_t"))


@register("seed_edges", SQL_HORIZON + """
SELECT query_id, edge_id, CAST(from_t AS BIGINT) AS from_t, CAST(to_t AS BIGINT) AS to_t FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, arr_node, path ORDER BY to_t, from_t, edge_id) AS rn FROM hh) s
WHERE rn = 1""")
def q_seed_edges(spark, d):
    from transitrisk.operators.transfers import seed_rides
    s = seed_rides(_depart_q(spark, d), orient_rides(_rides(spark, d), "depart"), "depart")
    return s.select("query_id", "edge_id", bi("from_t").alias("from_t"), bi("to_t").alias("to_t"))


@register("direction_flags", SQL_HORIZON.rstrip() + f""",
{V.SQL_JSTOPS},
s AS (
  SELECT query_id, edge_id, arr_node, dep_node, target,
         row_number() OVER (PARTITION BY query_id, arr_node, path ORDER BY to_t, from_t, edge_id) AS rn FROM hh)
SELECT s.query_id, s.edge_id,
       {hav_sql('b.lat', 'b.lon', 't.lat', 't.lon')} < {hav_sql('a.lat', 'a.lon', 't.lat', 't.lon')} AS nice
FROM s JOIN v_jstops a ON a.stop = s.dep_node JOIN v_jstops b ON b.stop = s.arr_node
JOIN v_jstops t ON t.stop = s.target WHERE rn = 1""")
def q_direction_flags(spark, d):
    from transitrisk.operators.transfers import seed_rides
    from transitrisk.plans.journeys import direction_flags
    s = seed_rides(_depart_q(spark, d), orient_rides(_rides(spark, d), "depart"), "depart")
    f = direction_flags(s, V.jstops(_events(spark, d)), "from_node", "to_node", "target")
    return f.select("query_id", "edge_id", "nice")


SQL_XFER_BASE = V.with_views(V.SQL_RIDES, SQL_RIDE_PATHS, V.SQL_EXP_DISTS, V.SQL_JSTOPS, SQL_JWALKS).rstrip() + f""",
vias AS (
  SELECT x.*, x.arr_node AS via, 0 AS walk_s, CAST(NULL AS VARCHAR) AS prev_node FROM v_r x
  UNION ALL
  SELECT x.*, w.arr_node AS via, w.walk_s, w.dep_node AS prev_node FROM v_r x
  JOIN v_walks w ON w.dep_node = x.arr_node WHERE w.arr_node <> x.dep_node),
pairs AS (
  SELECT v.edge_id AS x_edge, e.edge_id AS e_edge, v.via, v.walk_s, v.prev_node IS NOT NULL AS is_walk,
         ((e.dep_sow - v.arr_sow) % {WEEK_S} + {WEEK_S}) % {WEEK_S} AS gap,
         e.arr_sow - e.dep_sow AS e_dur, e.arr_node AS e_arr, e.path AS e_path, v.dist_id AS x_dist
  FROM vias v JOIN v_r e ON e.dep_node = v.via
  WHERE (v.trip_id <> e.trip_id OR v.day_start <> e.day_start) AND v.path <> e.path
    AND CASE WHEN v.prev_node IS NOT NULL THEN e.arr_node <> v.prev_node ELSE e.arr_node <> v.dep_node END),
xp AS (
  SELECT p.*, gap - walk_s - {BUFFER_S} AS slack,
         {SQL_EXP_P.format(s='gap - walk_s - ' + str(BUFFER_S))} AS p
  FROM pairs p JOIN v_dists d ON d.dist_id = p.x_dist
  WHERE gap >= walk_s AND gap <= {DAY_S})
"""


def _xfer(spark, d, direct=True, walks=True, cutoff=False):
    w = _direct_walks(spark, d) if walks else None
    return transfer_table(_rides(spark, d), w, _grids(spark, d), SearchParams(BUFFER_S, CUTOFF),
                          direct=direct, cutoff=cutoff)


def _xfer_out(t):
    return t.select("x_edge", "e_edge", "via", bi("walk_s").alias("walk_s"), bi("gap").alias("gap"),
                    r6("p").alias("p"))


_XFER_SEL = ("SELECT x_edge, e_edge, via, CAST(walk_s AS BIGINT) AS walk_s, CAST(gap AS BIGINT) AS gap, "
             "round(p, 6) AS p FROM ")


@register("transfer_candidates", SQL_XFER_BASE + _XFER_SEL + "xp WHERE NOT is_walk")
def q_transfer_candidates(spark, d):
    return _xfer_out(_xfer(spark, d, direct=True, walks=False))


@register("walk_transfers", SQL_XFER_BASE + _XFER_SEL + "xp WHERE is_walk")
def q_walk_transfers(spark, d):
    return _xfer_out(_xfer(spark, d, direct=False, walks=True))


@register("transfer_cutoff", SQL_XFER_BASE.rstrip() + f""",
cut AS (
  SELECT *, max(CASE WHEN p > {CUTOFF} THEN 1 ELSE 0 END) OVER (
      PARTITION BY x_edge, via, e_arr, e_path ORDER BY gap + e_dur, gap, e_edge
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM xp)
""" + _XFER_SEL + "cut WHERE coalesce(seen, 0) = 0")
def q_transfer_cutoff(spark, d):
    return _xfer_out(_xfer(spark, d, direct=True, walks=True, cutoff=True))


def _plans(spark, d, mode, with_itinerary=False):
    from transitrisk.plans.journeys import plan
    q = V.plan_queries(_events(spark, d), mode)
    return plan(q, _ride_timetable(spark, d), with_itinerary=with_itinerary)


@register("plan_depart")
def q_plan_depart(spark, d):
    s, _ = _plans(spark, d, "depart")
    return s.select("query_id", "status", bi("dep_sow").alias("dep_sow"), bi("arr_sow").alias("arr_sow"),
                    r6("prob").alias("prob"), bi("n_rides").alias("n_rides"))


@register("plan_arrive")
def q_plan_arrive(spark, d):
    s, _ = _plans(spark, d, "arrive")
    return s.select("query_id", "status", bi("dep_sow").alias("dep_sow"), bi("arr_sow").alias("arr_sow"),
                    r6("prob").alias("prob"), bi("n_rides").alias("n_rides"))


@register("itinerary")
def q_itinerary(spark, d):
    from transitrisk.plans.journeys import itinerary_display
    _, it = _plans(spark, d, "depart", with_itinerary=True)
    it = itinerary_display(it, V.jstops(_events(spark, d)))
    return it.select("query_id", bi("leg").alias("leg"), "kind", bi("trip_id").alias("trip_id"), "dep_node",
                     "arr_node", bi("dep_sow").alias("dep_sow"), bi("arr_sow").alias("arr_sow"),
                     "dep_clock", "arr_clock", r6("prob").alias("prob"))


def _iso(spark, d):
    from transitrisk.plans.isochrones import isochrones
    return isochrones(V.iso_queries(_events(spark, d)), _ride_timetable(spark, d))


@register("isochrone")
def q_isochrone(spark, d):
    r, _ = _iso(spark, d)
    return r.select("query_id", "stop", bi("arr_sow").alias("arr_sow"), r6("radius_m").alias("radius_m"))


@register("isochrone_layer")
def q_isochrone_layer(spark, d):
    from transitrisk.plans.isochrones import isochrone_layer
    r, _ = _iso(spark, d)
    l = isochrone_layer(r, V.jstops(_events(spark, d)))
    return l.select("query_id", "stop", bi("arr_sow").alias("arr_sow"), r6("radius_m").alias("radius_m"),
                    r6("x").alias("x"), r6("y").alias("y"))


@register("isochrone_arrive")
def q_isochrone_arrive(spark, d):
    """From where can each user's last stop still be reached by the last event, leaving at most 2 h before."""
    from transitrisk.plans.isochrones import isochrones
    q = V.iso_queries(_events(spark, d), mode="arrive")
    r, _ = isochrones(q, _ride_timetable(spark, d), mode="arrive")
    return r.select("query_id", "stop", bi("dep_sow").alias("dep_sow"), r6("radius_m").alias("radius_m"))


def _full_itinerary(spark, d):
    from transitrisk.plans.journeys import itinerary_edges
    _, it = _plans(spark, d, "depart", with_itinerary=True)
    return itinerary_edges(it, _ride_timetable(spark, d).rides)


@register("itinerary_edges")
def q_itinerary_edges(spark, d):
    it = _full_itinerary(spark, d)
    return it.select("query_id", bi("step").alias("step"), "kind", bi("trip_id").alias("trip_id"), "dep_node", "arr_node",
                     bi("dep_sow").alias("dep_sow"), bi("arr_sow").alias("arr_sow"), r6("prob").alias("prob"))


@register("itinerary_stops")
def q_itinerary_stops(spark, d):
    from transitrisk.plans.journeys import itinerary_stops
    t = itinerary_stops(_full_itinerary(spark, d), V.jstops(_events(spark, d)))
    return t.select("query_id", bi("pos").alias("pos"), "stop", bi("arr_sow").alias("arr_sow"), bi("dep_sow").alias("dep_sow"),
                    "arr_clock", "dep_clock", r6("lon").alias("lon"), r6("lat").alias("lat"))


SQL_REJECT_QUERIES = """q AS (
  SELECT user_id - CASE WHEN user_id % 17 = 1 THEN 1 ELSE 0 END AS query_id,
         CASE WHEN user_id % 11 = 3 THEN 'Depart' WHEN user_id % 11 = 5 THEN NULL ELSE 'depart' END AS mode,
         CASE WHEN user_id % 19 = 2 THEN 'nowhere' ELSE f_stop END AS dep_node, l_stop AS arr_node,
         CASE WHEN user_id % 23 = 4 THEN NULL ELSE f_sow END AS t_sow,
         CASE WHEN user_id % 13 = 4 THEN NULL ELSE (user_id % 7) / 5.0 END AS threshold FROM v_ue)"""


@register("query_rejects", V.with_views(V.SQL_RIDES, SQL_RIDE_PATHS, V.SQL_EXP_DISTS, V.SQL_USER_ENDS, V.SQL_JSTOPS, SQL_JWALKS,
                                        SQL_REJECT_QUERIES) + """
SELECT query_id, reason FROM (SELECT query_id, CASE
    WHEN count(*) OVER (PARTITION BY query_id) > 1 THEN 'duplicate query_id'
    WHEN mode IS NULL OR mode NOT IN ('depart', 'arrive') THEN 'unknown mode'
    WHEN t_sow IS NULL THEN 'time missing or malformed'
    WHEN dep_node NOT IN (SELECT dep_node FROM v_rides UNION SELECT dep_node FROM v_walks) THEN 'unknown departure stop'
    WHEN arr_node NOT IN (SELECT arr_node FROM v_rides UNION SELECT arr_node FROM v_walks) THEN 'unknown arrival stop'
    WHEN threshold IS NULL OR threshold < 0 OR threshold > 1 THEN 'threshold outside [0, 1]' END AS reason FROM q) v
WHERE reason IS NOT NULL""")
def q_query_rejects(spark, d):
    """Bad modes, missing times and thresholds, unknown stops and repeated ids: each has its reason."""
    from transitrisk.plans.journeys import _validate
    e = _events(spark, d)
    i = F.col("query_id")
    q = V.plan_queries(e, "depart").withColumns({
        "mode": F.when(i % 11 == 3, "Depart").when(i % 11 == 5, F.lit(None)).otherwise("depart"),
        "dep_node": F.when(i % 19 == 2, "nowhere").otherwise(F.col("dep_node")),
        "t_sow": F.when(i % 23 != 4, F.col("t_sow")),
        "threshold": F.when(i % 13 != 4, (i % 7) / 5.0)})
    q = q.withColumn("query_id", i - F.when(i % 17 == 1, 1).otherwise(0))
    _, rej = _validate(q, V.rides(e), _direct_walks(spark, d))
    return rej.select("query_id", "reason")


@register("plan_depart_fitted")
def q_plan_depart_fitted(spark, d):
    """The whole flow: observed timetable, KMeans clusters, fitted gamma laws,
    and one depart-at plan per user between the stops of the first and last event."""
    from transitrisk.plans.flow import build_timetable_from_obs
    from transitrisk.plans.journeys import plan
    e = _events(spark, d)
    stops = e.select(F.col("event_type").alias("stop")).distinct().withColumns(
        {"lon": F.lit(V.JSTOP_LON0) + F.ascii("stop") * V.JSTOP_DLON, "lat": F.lit(V.JSTOP_LAT0)})
    tt, _ = build_timetable_from_obs(spark, _obs(spark, d), stops, min_support=MIN_SUPPORT)
    kind = lambda c: F.regexp_extract(c, "^(.*)_[0-9]+$", 1)
    q = V.plan_queries(e, "depart").withColumns({"dep_node": kind("dep_node"), "arr_node": kind("arr_node")})
    s, _ = plan(q, tt)
    return s.select("query_id", "status", bi("dep_sow").alias("dep_sow"), bi("arr_sow").alias("arr_sow"),
                    r6("prob").alias("prob"), bi("n_rides").alias("n_rides"))


def _daily_counts(spark, d):
    from transitrisk.session import scratch_path
    obs = _obs(spark, d).select("stop", F.date_format("service_date", "yyyy-MM-dd").alias("day"), F.col("arrival_delay").alias("delay"))
    path = scratch_path(spark, "delay-summary")
    counts = SU.period_counts(obs, "stop", "day")
    odd = F.dayofmonth(F.to_date("period")) % 2 == 1
    for some in (odd, ~odd):  # two loads, of different days
        SU.write_periods(counts.where(some), path)
    return SU.merged_counts(spark, path, "stop")


_QUANTS = ", ".join(f"round(quantile_cont(arrival_delay, {p / 100}), 6) AS p{p}" for p in D.PERCENTILES)


@register("delay_summary", V.with_views(V.SQL_OBS) + f"""
SELECT stop, CAST(count(*) AS BIGINT) AS n, round(avg(arrival_delay), 6) AS mean, round(stddev_samp(arrival_delay), 6) AS std, {_QUANTS}
FROM v_obs WHERE arrival_delay IS NOT NULL GROUP BY stop""")
def q_delay_summary(spark, d):
    """Moments and percentiles per stop from daily counts stored in two loads and merged."""
    s = SU.summary_stats(_daily_counts(spark, d), "stop")
    return s.select("stop", bi("n").alias("n"), *[r6(c).alias(c) for c in ("mean", "std", *D.FEATURE_COLS)])


QUANTILE_PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]


@register("delay_quantiles", V.with_views(V.SQL_OBS) + f"""
SELECT CAST(p AS DOUBLE) AS prob, round(q, 6) AS quantile FROM (
  SELECT unnest({QUANTILE_PROBS}) AS p, unnest(quantile_cont(CAST(arrival_delay AS DOUBLE), {QUANTILE_PROBS})) AS q FROM v_obs)""")
def q_delay_quantiles(spark, d):
    """Exact quantiles of all delays without gathering them in one task (A5)."""
    return SU.exact_quantiles(_obs(spark, d), "arrival_delay", QUANTILE_PROBS).select("prob", r6("quantile").alias("quantile"))


@register("law_choice", V.with_views(V.SQL_OBS) + """
SELECT stop, CAST(count(*) AS BIGINT) AS n, true AS no_worse, true AS below_min FROM v_obs WHERE arrival_delay IS NOT NULL GROUP BY stop""")
def q_law_choice(spark, d):
    """Invariants of the law chosen per stop: at least as near as the location-fixed fit, starting below the least delay."""
    counts = D.delay_counts(_obs(spark, d).select("stop", F.col("arrival_delay").alias("delay")), "stop")
    least = counts.groupBy("stop").agg(F.min("value").alias("least"))
    return SU.choose_laws(counts, "stop").join(least, "stop").select(
        "stop", bi("n").alias("n"), (F.col("ks") <= F.col("ks_fixed")).alias("no_worse"),
        (F.col("loc") <= F.col("least")).alias("below_min"))


def queries() -> dict[str, QueryFn]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# ------------------------------------------------------------ SQL oracles for the searches
# A keyed recursive CTE is a label-correcting dynamic program: one row per
# (query, ride edge), replaced only by a strictly better (prob, start, fewer
# rides) label; it is an independent formulation of the same specification.

SQL_RIDE_SEGS = """v_rs AS (
  SELECT *, sum(brk) OVER (PARTITION BY trip_id, day_start ORDER BY dep_sow, edge_id ROWS UNBOUNDED PRECEDING) AS seg,
         row_number() OVER (PARTITION BY trip_id, day_start ORDER BY dep_sow, edge_id) AS seq
  FROM (SELECT *, CASE WHEN lag(arr_node) OVER w <> dep_node OR lag(arr_sow) OVER w > dep_sow THEN 1 ELSE 0 END AS brk
        FROM v_r WINDOW w AS (PARTITION BY trip_id, day_start ORDER BY dep_sow, edge_id)) t)"""


def _search_sql(mode: str, iso: bool) -> str:
    dep = mode == "depart"
    W, Dd = WEEK_S, DAY_S
    fn, tn = ("dep_node", "arr_node") if dep else ("arr_node", "dep_node")
    from_abs = f"((dep_sow % {W}) + {W}) % {W}" if dep else f"((arr_sow % {W}) + {W}) % {W}"
    from_t = f"((from_abs - q.T) % {W} + {W}) % {W}" if dep else f"((q.T - from_abs) % {W} + {W}) % {W}"
    same_day = f"from_t < {Dd} - T % {Dd}" if dep else f"from_t <= T % {Dd}"
    wa, wb = ("dep_node", "arr_node") if dep else ("arr_node", "dep_node")
    law = "l.dist_id" if dep else "CASE WHEN l.virtual AND NOT w.is_walk THEN NULL ELSE e.dist_id END"
    if dep:
        p14w = "(l.from_node IS NULL OR w.b <> l.from_node) AND (w.prev IS NULL OR e.to_node <> w.prev)"
    else:
        p14w = "(w.a <> e.to_node) AND (l.from_node IS NULL OR l.from_node <> w.prev)"
    walk_start = "0" if dep else "c.from_t - c.walk_s"
    seq_cmp = "c.seq >= b.seq" if dep else "c.seq <= b.seq"
    if iso:
        end = "f" if dep else "l"
        head = f"""q0 AS (SELECT user_id AS query_id, {end}_stop AS start, CAST({end}_sow AS BIGINT) AS T,
                   {V.ISO_RANGE_S} AS bound, {V.DEFAULT_THRESHOLD} AS threshold FROM v_ue),
q AS (SELECT *, CAST(NULL AS VARCHAR) AS target FROM q0
      WHERE start IN (SELECT {fn} FROM v_rides UNION SELECT {fn} FROM v_walks)
        AND threshold BETWEEN 0 AND 1 AND bound BETWEEN 0 AND {Dd})"""
    else:
        t_col = "f_sow" if dep else "l_sow"
        st, tg = ("dep_node", "arr_node") if dep else ("arr_node", "dep_node")
        head = f"""q0 AS (SELECT user_id AS query_id, f_stop AS dep_node, l_stop AS arr_node, CAST({t_col} AS BIGINT) AS T,
                   {V.DEFAULT_THRESHOLD} AS threshold FROM v_ue),
qv AS (SELECT q0.*, CASE
         WHEN dep_node NOT IN (SELECT dep_node FROM v_rides UNION SELECT dep_node FROM v_walks)
           THEN 'rejected: unknown departure stop'
         WHEN arr_node NOT IN (SELECT arr_node FROM v_rides UNION SELECT arr_node FROM v_walks)
           THEN 'rejected: unknown arrival stop'
         WHEN threshold < 0 OR threshold > 1 THEN 'rejected: threshold outside [0, 1]'
         WHEN dep_node = arr_node THEN 'trivial' END AS pre FROM q0),
q AS (SELECT query_id, T, threshold, {st} AS start, {tg} AS target, {Dd} AS bound FROM qv WHERE pre IS NULL)"""
    body = f"""
sr AS (SELECT edge_id, trip_id, day_start, seg, seq, path, dist_id, {fn} AS from_node, {tn} AS to_node,
              {from_abs} AS from_abs, arr_sow - dep_sow AS dur FROM v_rs),
qr AS (SELECT q.query_id, q.T, q.bound, sr.*, {from_t} AS from_t FROM q, sr),
qrh AS (SELECT *, from_t + dur AS to_t FROM qr
        WHERE from_t > 0 AND ({same_day} OR from_t + dur < {Dd}) AND from_t + dur <= bound),
sw AS (SELECT {wa} AS a, {wb} AS b, walk_s, dep_node AS prev, true AS is_walk FROM v_walks),
vw AS (SELECT * FROM sw UNION ALL
       SELECT DISTINCT s AS a, s AS b, 0, CAST(NULL AS VARCHAR), false FROM
         (SELECT dep_node AS s FROM v_rides UNION SELECT arr_node FROM v_rides UNION SELECT start FROM q) t),
lab(query_id, edge_id, prob, start_t, nrn, to_node, to_t, from_node, path, trip_id, day_start, dist_id,
    virtual, threshold) USING KEY (query_id, edge_id) AS (
  SELECT query_id, -1, CAST(1.0 AS DOUBLE), 0, 0, start, 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR[]), CAST(NULL AS BIGINT),
         CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), true, threshold FROM q
  UNION
  (SELECT nl.* FROM (
    SELECT c.query_id, c.edge_id, max({{'prob': b.prob, 'start_t': b.start_t, 'nrn': b.nrn}}).prob AS prob,
           max({{'prob': b.prob, 'start_t': b.start_t, 'nrn': b.nrn}}).start_t AS start_t,
           max({{'prob': b.prob, 'start_t': b.start_t, 'nrn': b.nrn}}).nrn AS nrn,
           any_value(c.to_node) AS to_node, any_value(c.to_t) AS to_t,
           any_value(c.from_node) AS from_node, any_value(c.path) AS path, any_value(c.trip_id) AS trip_id,
           any_value(c.day_start) AS day_start, any_value(c.dist_id) AS dist_id, false AS virtual,
           any_value(b.threshold) AS threshold
    FROM (
      SELECT query_id, edge_id, max(x) AS b_x FROM (
        SELECT c.*, c.lprob * c.p AS nprob,
               {{'prob': c.lprob * c.p,
                 'start_t': CASE WHEN c.virtual THEN CASE WHEN c.is_walk THEN {walk_start} ELSE c.from_t END ELSE c.lstart END,
                 'nrn': c.lnrn - 1, 'threshold': c.threshold, 'seq': c.seq,
                 'trip_id': c.trip_id, 'day_start': c.day_start, 'seg': c.seg}} AS x
        FROM (
          SELECT l.query_id, l.edge_id AS x_edge, l.virtual, l.prob AS lprob, l.start_t AS lstart, l.nrn AS lnrn,
                 l.threshold, w.a, w.b, w.walk_s, w.is_walk, e.edge_id, e.to_node, e.path, e.from_t,
                 e.to_t, e.trip_id, e.day_start, e.seg, e.seq,
                 CASE WHEN {law} IS NULL THEN CAST(1.0 AS DOUBLE)
                      WHEN e.from_t - l.to_t - w.walk_s - {BUFFER_S} <= 0 THEN CAST(0.0 AS DOUBLE)
                      ELSE 1 - exp(-(e.from_t - l.to_t - w.walk_s - {BUFFER_S}) / dl.scale) END AS p
          FROM lab l JOIN vw w ON w.a = l.to_node
          JOIN qrh e ON e.query_id = l.query_id AND e.from_node = w.b
          LEFT JOIN v_dists dl ON dl.dist_id = {law}
          WHERE e.from_t >= l.to_t + w.walk_s
            AND (l.virtual OR NOT (e.trip_id = l.trip_id AND e.day_start = l.day_start))
            AND (l.virtual OR e.path <> l.path)
            AND CASE WHEN w.is_walk THEN {p14w} ELSE (l.from_node IS NULL OR e.to_node <> l.from_node) END
        ) c
        QUALIFY coalesce(max(CASE WHEN c.p > {CUTOFF} THEN 1 ELSE 0 END) OVER (
                  PARTITION BY c.query_id, c.x_edge, c.virtual, c.a, c.b, c.to_node, c.path
                  ORDER BY c.to_t, c.from_t, c.edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
      ) k WHERE nprob > threshold
      GROUP BY query_id, edge_id
    ) bb
    CROSS JOIN LATERAL (SELECT bb.b_x.prob AS prob, bb.b_x.start_t AS start_t, bb.b_x.nrn AS nrn,
                               bb.b_x.threshold AS threshold, bb.b_x.seq AS seq, bb.b_x.trip_id AS trip_id,
                               bb.b_x.day_start AS day_start, bb.b_x.seg AS seg) b
    JOIN qrh c ON c.query_id = bb.query_id AND c.trip_id = b.trip_id AND c.day_start = b.day_start
               AND c.seg = b.seg AND {seq_cmp}
    GROUP BY c.query_id, c.edge_id) nl
   LEFT JOIN recurring.lab o ON o.query_id = nl.query_id AND o.edge_id = nl.edge_id
   WHERE o.edge_id IS NULL OR nl.prob > o.prob OR (nl.prob = o.prob AND (nl.start_t > o.start_t
         OR (nl.start_t = o.start_t AND nl.nrn > o.nrn))))
)"""
    base = V.with_views(V.SQL_RIDES, SQL_RIDE_PATHS, SQL_RIDE_SEGS, V.SQL_EXP_DISTS, V.SQL_JSTOPS,
                        SQL_JWALKS, V.SQL_USER_ENDS).rstrip()
    sql = base.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + head + ",\n" + body
    if iso:
        return sql + f"""
, r AS (
  SELECT query_id, to_node AS stop, to_t AS rt FROM lab WHERE NOT virtual
  UNION ALL SELECT l.query_id, w.b, l.to_t + w.walk_s FROM lab l JOIN sw w ON w.a = l.to_node WHERE NOT l.virtual
  UNION ALL SELECT q.query_id, w.b, w.walk_s FROM q JOIN sw w ON w.a = q.start WHERE q.threshold < 1)
SELECT q.query_id, m.stop, CAST({"q.T + m.rt" if dep else "q.T - m.rt"} AS BIGINT) AS {"arr_sow" if dep else "dep_sow"}, round(CAST(q.bound - m.rt AS DOUBLE) * 1.0, 6) AS radius_m
FROM (SELECT query_id, stop, min(rt) AS rt FROM (
        SELECT r.* FROM r JOIN q USING (query_id) WHERE r.rt <= q.bound
        UNION ALL SELECT query_id, start, 0 FROM q) u GROUP BY query_id, stop) m JOIN q USING (query_id)"""
    dep_sow = "q.T + b.start_t" if dep else "q.T - b.arr_t"
    arr_sow = "q.T + b.arr_t" if dep else "q.T - b.start_t"
    return sql + f"""
, arr AS (
  SELECT l.query_id, l.to_t AS arr_t, l.prob, l.start_t, l.nrn FROM lab l JOIN q USING (query_id)
  WHERE NOT l.virtual AND l.to_node = q.target
  UNION ALL
  SELECT l.query_id, l.to_t + w.walk_s, l.prob, l.start_t, l.nrn FROM lab l JOIN q USING (query_id)
  JOIN sw w ON w.a = l.to_node
  WHERE w.b = q.target AND (l.from_node IS NULL OR w.b <> l.from_node) AND l.prob > q.threshold),
b AS (SELECT * FROM arr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY arr_t, prob DESC, start_t DESC, nrn DESC) = 1)
SELECT qv.query_id,
       coalesce(qv.pre, CASE WHEN b.query_id IS NULL THEN 'no_path' ELSE 'ok' END) AS status,
       CAST(CASE WHEN qv.pre = 'trivial' THEN qv.T WHEN b.query_id IS NOT NULL THEN {dep_sow.replace('q.T', 'qv.T')} END AS BIGINT) AS dep_sow,
       CAST(CASE WHEN qv.pre = 'trivial' THEN qv.T WHEN b.query_id IS NOT NULL THEN {arr_sow.replace('q.T', 'qv.T')} END AS BIGINT) AS arr_sow,
       round(CAST(CASE WHEN qv.pre = 'trivial' THEN 1.0 ELSE b.prob END AS DOUBLE), 6) AS prob,
       CAST(CASE WHEN qv.pre = 'trivial' THEN 0 ELSE -b.nrn END AS BIGINT) AS n_rides
FROM qv LEFT JOIN b ON b.query_id = qv.query_id"""


ORACLE["plan_depart"] = _search_sql("depart", iso=False)
ORACLE["plan_arrive"] = _search_sql("arrive", iso=False)
ORACLE["isochrone"] = _search_sql("depart", iso=True)
ORACLE["isochrone_arrive"] = _search_sql("arrive", iso=True)

ORACLE["isochrone_layer"] = (
    _search_sql("depart", iso=True).replace(
        "SELECT q.query_id, m.stop, CAST(q.T + m.rt AS BIGINT) AS arr_sow, round(CAST(q.bound - m.rt AS DOUBLE) * 1.0, 6) AS radius_m",
        "SELECT q.query_id, m.stop, CAST(q.T + m.rt AS BIGINT) AS arr_sow, round(CAST(q.bound - m.rt AS DOUBLE) * 1.0, 6) AS radius_m, "
        "round(6378137.0 * radians(s.lon), 6) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(s.lat) / 2)), 6) AS y")
    .replace("GROUP BY query_id, stop) m JOIN q USING (query_id)",
             "GROUP BY query_id, stop) m JOIN q USING (query_id) JOIN v_jstops s ON s.stop = m.stop"))


@register("edge_distributions")
def q_edge_distributions(spark, d):
    """The delay model end to end (A8, M1, M3, J8, A9, A10, J7): supported
    timetable edges → percentile features → KMeans → gamma law per cluster
    → law attached to every edge."""
    obs = _obs(spark, d)
    edges = TT.finalize_edges(TT.support_filter(TT.valid_edges(
        TT.consecutive_pairs(TT.delay_stats(obs))), MIN_SUPPORT))
    long = D.edge_delays(edges, obs)
    feats = C.features(D.delay_percentiles(long, "edge_id"))
    labels = C.cluster_labels(feats, C.K_CHOSEN).select("edge_id", "cluster")
    pooled = long.join(labels, "edge_id").select("cluster", "delay")
    fits = D.fit_gamma(D.gamma_stats(pooled, "cluster"))
    out = D.attach_distribution(edges.join(labels, "edge_id"), fits)
    return out.select("trip_id", "day_start", "dep_node", "arr_node", bi("dep_day").alias("dep_day"),
                      bi("dep_sod").alias("dep_sod"), bi("cluster").alias("cluster"), "method",
                      r6("shape").alias("shape"), r6("loc").alias("loc"), r6("scale").alias("scale"))
