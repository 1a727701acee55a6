"""Dated storage (S3, S4, P12): daily actuals files loaded as they come, and rides
partitioned by departure day.

A store is two Parquet tables under one folder. ``files`` has a row per loaded
version of a file (name, size, time of change, load number); ``days`` has the
files' rows, partitioned by service date and load. A load writes its rows first
and names its files last: rows of a load that died in between belong to no named
file and are never read, and the next load takes those files again. A file that
changed is loaded anew and its older version no longer counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitrisk.functions.timeops import DAY_S, WEEK_S
from transitrisk.sources.actuals import OBS_COLUMNS, normalize_actuals, read_actuals
from transitrisk.sources.storage import read_stage, write_stage
from transitrisk.operators.timetable import MAX_EDGE_MIN

FILES_SCHEMA = "file string, length long, changed timestamp, load long"
DAYS_SCHEMA = ("trip_id string, stop string, day_start int, week_day int, arr_sod int, dep_sod int, "
               "arrival_delay long, departure_delay long, file string, service_date date, load long")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def loaded_files(spark: SparkSession, store: str) -> DataFrame:
    """(file, length, changed, load): the version of each file that counts."""
    newest = Window.partitionBy("file").orderBy(F.desc("load"))
    return (_table(spark, f"{store}/files", FILES_SCHEMA).withColumn("_rank", F.row_number().over(newest))
            .where("_rank = 1").drop("_rank"))


def new_files(spark: SparkSession, paths: str, store: str) -> DataFrame:
    """(file, length, changed) of files not loaded as they are now; contents are not read."""
    listed = (spark.read.format("binaryFile").load(paths)
              .select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("changed")))
    return listed.join(loaded_files(spark, store).drop("load"), ["file", "length", "changed"], "left_anti")


def load_new_days(spark: SparkSession, paths: str, store: str) -> int:
    """Loads the files of ``paths`` (a glob) that are new or changed; returns how many.

    Only these are opened. Rows are those of ``normalize_actuals``. File names, as
    many as there are new files, pass through the driver, which lists them anyway."""
    fresh = new_files(spark, paths, store).collect()
    if not fresh:
        return 0
    files = f"{store}/files"
    load = _table(spark, files, FILES_SCHEMA).agg(F.coalesce(F.max("load"), F.lit(0)) + 1).first()[0]
    raw = read_actuals(spark, [r["file"] for r in fresh], with_file=True)
    # a day's rows meet in a few files of its folder, spread by trip
    rows = (normalize_actuals(raw, keep=("file",)).withColumn("load", F.lit(load).cast("long"))
            .repartition("service_date", F.pmod(F.xxhash64("trip_id"), F.lit(8))))
    # a load that died under the same number is replaced, whichever days it had reached
    write_stage(rows, f"{store}/days/load={load}", ["service_date"])
    named = spark.createDataFrame([(r["file"], r["length"], r["changed"], load) for r in fresh], FILES_SCHEMA)
    write_stage(named.coalesce(1), files, mode="append")
    return len(fresh)


def read_days(spark: SparkSession, store: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Observations of the days from ``first`` to ``last``; other days' folders, loads
    no longer named and older versions of files are not read."""
    days = _table(spark, f"{store}/days", DAYS_SCHEMA)
    if first is not None:
        days = days.where(F.col("service_date") >= F.lit(first).cast("date"))
    if last is not None:
        days = days.where(F.col("service_date") <= F.lit(last).cast("date"))
    current = loaded_files(spark, store).select("file", "load")
    return days.join(current, ["load", "file"], "left_semi").select(*OBS_COLUMNS)


def write_rides_by_day(rides: DataFrame, path: str) -> str:
    """Rides in a folder per departure day of the week."""
    day = F.floor(F.pmod(F.col("dep_sow"), F.lit(WEEK_S)) / DAY_S).cast("int")
    return write_stage(rides.withColumn("dep_day", day).repartition("dep_day", "dep_node"), path, ["dep_day"])


def days_needed(queries: DataFrame, mode: str, horizon_s: int = DAY_S, longest_ride_s: int = 60 * MAX_EDGE_MIN) -> DataFrame:
    """(dep_day): days of the week on which rides within the horizon of a query
    (column T, second of the week) depart. Arriving by T, a ride may set out its own
    length before the horizon. Queries without a time in the week ask for none."""
    t = F.col("T")
    lo, hi = (t, t + horizon_s) if mode == "depart" else (t - horizon_s - longest_ride_s, t)
    span = F.sequence(F.floor(lo / DAY_S), F.least(F.floor(hi / DAY_S), F.floor(lo / DAY_S) + 6))
    return (queries.where((t >= 0) & (t < WEEK_S)).select(F.explode(span).alias("d"))
            .select(F.pmod("d", F.lit(7)).cast("int").alias("dep_day")).distinct())


def rides_needed(spark: SparkSession, path: str, queries: DataFrame, mode: str, **kw) -> DataFrame:
    """Rides of the days that the queries need. The days (seven at most) are broadcast
    and prune the other days' folders when the plan runs."""
    days = F.broadcast(days_needed(queries, mode, **kw))
    return read_stage(spark, path).join(days, "dep_day", "left_semi")
