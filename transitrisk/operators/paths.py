"""Ordered stop path per run and its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitrisk.session import scratch_path

RUN_KEY = ["trip_id", "day_start"]


def run_paths(edges: DataFrame, order_col: str = "dep_sow", run_key=RUN_KEY) -> DataFrame:
    """Departure stops of a run in time order plus the last arrival stop.

    Order is the time since the run's start day, so a run crossing Sunday
    night keeps its Monday legs last. ``path_id`` is a 64-bit hash of the
    stop list (no global numbering pass is needed).
    """
    rel = F.pmod(F.col(order_col) - F.col("day_start") * 86400, F.lit(7 * 86400))
    legs = F.array_sort(F.collect_list(F.struct(rel.alias("t"), F.col("dep_node").alias("d"),
                                                F.col("arr_node").alias("a"))))
    p = edges.groupBy(*run_key).agg(legs.alias("_legs"))
    path = F.concat(F.transform("_legs", lambda x: x["d"]),
                    F.array(F.element_at("_legs", -1)["a"]))
    return (p.select(*run_key, path.alias("path"))
            .withColumns({"path_id": F.xxhash64("path"), "n_stops": F.size("path")}))


def attach_path_id(edges: DataFrame, paths: DataFrame, run_key=RUN_KEY) -> DataFrame:
    """Left equi-join of the path key on the run."""
    return edges.join(paths.select(*run_key, "path_id"), on=list(run_key), how="left")


def path_dictionary(paths: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, path_no): exact dense numbers 0, 1, … of the distinct stop lists, in
    their order (A7). Null paths have none.

    The lists are cut into ranges, counted per range, and a range starts where the
    ranges before it end; only one row per range is summed up in one place. Numbers
    stored in ``known`` stay as they are and new lists follow after the largest."""
    spark = paths.sparkSession
    new = paths.select("path").where(F.col("path").isNotNull()).distinct()
    if known is not None:
        new = new.join(known.select("path"), "path", "left_anti")
    target = scratch_path(spark, "path-ranges")
    new.repartitionByRange("path").withColumn("part", F.spark_partition_id()).write.parquet(target)
    # written once: a range keeps its number when a task is run again
    ranged = spark.read.schema("path array<string>, part int").parquet(target)
    starts = (ranged.groupBy("part").agg(F.count(F.lit(1)).alias("held"))
              .select("part", F.coalesce(F.sum("held").over(
                  Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("path")) - 1
    numbered = ranged.withColumn("inside", inside).join(F.broadcast(starts), "part")
    if known is None:
        return numbered.select("path", (F.col("start") + F.col("inside")).cast("long").alias("path_no"))
    taken = known.agg((F.coalesce(F.max("path_no"), F.lit(-1)) + 1).alias("taken"))
    numbered = numbered.join(F.broadcast(taken)).select(
        "path", (F.col("taken") + F.col("start") + F.col("inside")).cast("long").alias("path_no"))
    return known.select("path", "path_no").unionByName(numbered)


def exact_path_ids(paths: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``paths`` with the dictionary's number as ``path_id`` instead of a hash, so that
    different stop lists never share a key. Lists are compared whole."""
    return (paths.drop("path_id").join(dictionary.select("path", F.col("path_no").alias("path_id")), "path", "left")
            .select(*paths.columns))


def chain_segments(edges: DataFrame, run_key=RUN_KEY) -> DataFrame:
    """Numbers the connected stretches of a run: a new stretch starts when an
    edge does not depart from where the previous one arrived (a dropped edge
    in between). Staying aboard is only possible inside a stretch."""
    w = Window.partitionBy(*run_key).orderBy("dep_sow", "edge_id")
    brk = ((F.lag("arr_node").over(w) != F.col("dep_node"))
           | (F.lag("arr_sow").over(w) > F.col("dep_sow"))).cast("int")
    return (edges.withColumn("_brk", F.coalesce(brk, F.lit(0)))
            .withColumns({"seg": F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                          "seq": F.row_number().over(w)})
            .drop("_brk"))
