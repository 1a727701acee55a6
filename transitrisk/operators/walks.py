"""Walking links and stop sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitrisk.functions.geo import grid_shape, haversine_m, walk_seconds

WALK_MAX_M = 500.0


def walk_pairs(stops: DataFrame, max_m: float = WALK_MAX_M, speed_mps: float = 1.0) -> DataFrame:
    """All ordered pairs of distinct stops within ``max_m`` metres.

    Cell-bucketed equi-join: stops are put on a grid whose cells are at
    least ``max_m`` wide at the highest latitude present and wrap at ±180°, one side is
    exploded to its 3×3 neighbourhood and joined on the cell id; the exact
    haversine test then filters. No cross product is planned.
    """
    max_lat = stops.select(F.max(F.abs("lat"))).first()[0]
    if max_lat is None:
        return stops.sparkSession.createDataFrame(
            [], "dep_node string, arr_node string, metres double, walk_s int")
    dlat, columns = grid_shape(max_m * 1.01, float(max_lat))
    cells = stops.select("stop", "lat", "lon",
                         F.floor(F.col("lat") / dlat).alias("cy"),
                         F.pmod(F.floor((F.col("lon") + 180.0) / (360.0 / columns)), F.lit(columns)).alias("cx"))
    near_y = F.array(*[F.col("cy") + i for i in (-1, 0, 1)])
    near_x = F.array_distinct(F.array(*[F.pmod(F.col("cx") + i, F.lit(columns)) for i in (-1, 0, 1)]))
    probe = (cells
             .withColumn("ny", F.explode(near_y)).withColumn("nx", F.explode(near_x))
             .select(F.col("stop").alias("a_stop"), F.col("lat").alias("a_lat"),
                     F.col("lon").alias("a_lon"), F.col("ny").alias("cy"), F.col("nx").alias("cx")))
    pairs = probe.join(cells, on=["cy", "cx"])
    metres = haversine_m("a_lat", "a_lon", "lat", "lon")
    return (pairs.where(F.col("a_stop") != F.col("stop"))
            .select(F.col("a_stop").alias("dep_node"), F.col("stop").alias("arr_node"),
                    metres.alias("metres"))
            .where(F.col("metres") <= F.lit(float(max_m)))
            .withColumn("walk_s", walk_seconds("metres", speed_mps)))


def timetable_stops(edges: DataFrame) -> DataFrame:
    """Distinct stops used by the timetable, sorted."""
    return (edges.select(F.col("dep_node").alias("stop"))
            .union(edges.select(F.col("arr_node").alias("stop")))
            .distinct().orderBy("stop"))


def stops_in_timetable(stops: DataFrame, edges: DataFrame) -> DataFrame:
    """Stations used by the timetable (J2): semi-join, no literal IN list."""
    return stops.join(timetable_stops(edges), on="stop", how="left_semi")


def observations_at_known_stops(obs: DataFrame, stops: DataFrame) -> DataFrame:
    """Observations whose stop is in the station list."""
    return obs.join(stops.select("stop"), on="stop", how="left_semi")


def connected_pair_distances(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Distance for every stop pair linked by a timetable edge (J5 re-aimed:
    the full N×N matrix is never built; pairs come from equi-joins)."""
    pairs = edges.select("dep_node", "arr_node").distinct()
    a = stops.select(F.col("stop").alias("dep_node"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = stops.select(F.col("stop").alias("arr_node"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    return (pairs.join(a, "dep_node").join(b, "arr_node")
            .select("dep_node", "arr_node", haversine_m("a_lat", "a_lon", "b_lat", "b_lon").alias("metres")))


def rides_and_walks(rides: DataFrame, walks: DataFrame) -> DataFrame:
    """One edge list with a ``kind`` column instead of a sentinel trip id."""
    return (rides.withColumn("kind", F.lit("ride"))
            .unionByName(walks.withColumn("kind", F.lit("walk")), allowMissingColumns=True))
