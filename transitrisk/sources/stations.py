"""Station coordinate file (S1, S2) and the radius filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitrisk.functions.geo import haversine_m


def read_station_lines(spark: SparkSession, path: str) -> DataFrame:
    """One text row per station line."""
    return spark.read.text(path)


def parse_station_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """``id lon lat height % name`` → (stop, lon, lat, station_id, height).

    Item 1 of the left part is the longitude and item 2 the latitude.
    Lines that do not parse give nulls and are dropped.
    """
    halves = F.split(F.col(value_col), " % ", 2)
    left = F.split(F.trim(F.get(halves, 0)), " +")
    out = lines.select(
        F.trim(F.get(halves, 1)).alias("stop"),
        F.get(left, 1).try_cast("double").alias("lon"),
        F.get(left, 2).try_cast("double").alias("lat"),
        F.get(left, 0).alias("station_id"),
        F.get(left, 3).try_cast("int").alias("height"),
    )
    return out.where(F.col("stop").isNotNull() & (F.col("stop") != "")
                     & F.col("lon").isNotNull() & F.col("lat").isNotNull())


def format_station_lines(stops: DataFrame, id_col: str = "station_id") -> DataFrame:
    """Inverse of ``parse_station_lines``: renders the text layout."""
    return stops.select(F.format_string(
        "%-9s %10.6f %10.6f %4d %% %s", F.col(id_col).cast("string"), F.col("lon"),
        F.col("lat"), F.coalesce(F.col("height"), F.lit(0)), F.col("stop")).alias("value"))


def within_radius(stops: DataFrame, centre_stop: str, radius_m: float) -> DataFrame:
    """Stops whose distance to the named centre stop is ≤ ``radius_m``.

    The centre is reduced to a single row and used through scalar
    subqueries, so no join or cross product is planned.
    """
    centre = stops.where(F.col("stop") == F.lit(centre_stop))
    c_lat = centre.select(F.avg("lat")).scalar()
    c_lon = centre.select(F.avg("lon")).scalar()
    dist = haversine_m(c_lat, c_lon, F.col("lat"), F.col("lon"))
    return (stops.withColumn("centre_m", dist)
            .where(F.col("centre_m") <= F.lit(float(radius_m))))
