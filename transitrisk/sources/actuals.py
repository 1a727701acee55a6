"""Stop-level actuals: ';'-separated daily files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitrisk.functions.timeops import sod_of

# Fixed values of the open-data file format: source column → engine name.
ACTUALS_COLUMNS = {
    "BETRIEBSTAG": "service_day",
    "FAHRT_BEZEICHNER": "trip_id",
    "PRODUKT_ID": "transport_type",
    "LINIEN_ID": "line_id",
    "HALTESTELLEN_NAME": "stop",
    "ANKUNFTSZEIT": "arr_sched",
    "AN_PROGNOSE": "arr_actual",
    "AN_PROGNOSE_STATUS": "arr_status",
    "ABFAHRTSZEIT": "dep_sched",
    "AB_PROGNOSE": "dep_actual",
    "AB_PROGNOSE_STATUS": "dep_status",
    "DURCHFAHRT_TF": "pass_through",
    "FAELLT_AUS_TF": "cancelled",
    "ZUSATZFAHRT_TF": "extra_trip",
}
# Formats and the status marking a measured time.
DATE_FMT = "dd.MM.yyyy"
SCHED_FMT = "dd.MM.yyyy HH:mm"
ACTUAL_FMT = "dd.MM.yyyy HH:mm:ss"
MEASURED = "GESCHAETZT"
OUTLIER_S = 1000

OBS_COLUMNS = ["trip_id", "stop", "service_date", "day_start", "week_day",
               "arr_sod", "dep_sod", "arrival_delay", "departure_delay"]


def read_actuals(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    """Reads the daily files (glob or list allowed) as strings and projects/renames (S3, P1);
    ``with_file`` adds the name of each row's file.

    No schema inference pass: every column is text, as in the source.
    Missing optional columns are filled with nulls. A file whose header does
    not match the others' is an error, never read by position.
    """
    reader = spark.read.option("sep", ";").option("header", True)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = reader.option("enforceSchema", False).schema(schema).csv(path)
    present = set(raw.columns)
    file = [F.col("_metadata.file_path").alias("file")] if with_file else []
    return raw.select(*[
        (F.col(src) if src in present else F.lit(None).cast("string")).alias(dst)
        for src, dst in ACTUALS_COLUMNS.items()], *file)


def normalize_actuals(raw: DataFrame, drop_outliers: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Projected actuals → observations with delays in seconds, and the columns ``keep``.

    * a side's delay is null unless that side's status is measured;
    * rows with no measured side, pass-through and cancelled rows are dropped;
    * a missing scheduled time falls back to the other side (trip start/end);
    * delays of ±1000 s or more are outliers.
    """
    arr_s = F.try_to_timestamp(F.col("arr_sched"), F.lit(SCHED_FMT))
    dep_s = F.try_to_timestamp(F.col("dep_sched"), F.lit(SCHED_FMT))
    arr_a = F.try_to_timestamp(F.col("arr_actual"), F.lit(ACTUAL_FMT))
    dep_a = F.try_to_timestamp(F.col("dep_actual"), F.lit(ACTUAL_FMT))
    arr_ok = F.col("arr_status") == F.lit(MEASURED)
    dep_ok = F.col("dep_status") == F.lit(MEASURED)
    truthy = ["true", "1"]

    df = (raw
          .where(F.coalesce(arr_ok, F.lit(False)) | F.coalesce(dep_ok, F.lit(False)))
          .where(~F.coalesce(F.lower(F.col("pass_through")).isin(truthy), F.lit(False)))
          .where(~F.coalesce(F.lower(F.col("cancelled")).isin(truthy), F.lit(False)))
          .withColumns({
              "_arr_s": arr_s, "_dep_s": dep_s,
              "arrival_delay": F.when(arr_ok, F.unix_timestamp(arr_a) - F.unix_timestamp(arr_s)),
              "departure_delay": F.when(dep_ok, F.unix_timestamp(dep_a) - F.unix_timestamp(dep_s)),
          })
          .withColumns({
              "_arr_t": F.coalesce(F.col("_arr_s"), F.col("_dep_s")),
              "_dep_t": F.coalesce(F.col("_dep_s"), F.col("_arr_s")),
              "service_date": F.try_to_date(F.col("service_day"), DATE_FMT),
          })
          .where(F.col("_arr_t").isNotNull() & F.col("service_date").isNotNull()))
    if drop_outliers:
        ok = lambda c: F.col(c).isNull() | (F.abs(F.col(c)) < F.lit(OUTLIER_S))
        df = df.where(ok("arrival_delay") & ok("departure_delay"))
    return df.select(
        F.col("trip_id"), F.col("stop"), F.col("service_date"),
        F.weekday("service_date").alias("day_start"),
        F.weekday(F.col("_arr_t")).alias("week_day"),
        sod_of("_arr_t").alias("arr_sod"),
        (sod_of("_dep_t") + F.lit(86400) * F.datediff(F.to_date("_dep_t"), F.to_date("_arr_t"))).alias("dep_sod"),
        F.col("arrival_delay").cast("bigint").alias("arrival_delay"),
        F.col("departure_delay").cast("bigint").alias("departure_delay"),
        *keep,
    )
