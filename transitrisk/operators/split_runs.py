"""Windows along a run cut into blocks of time (W1-W3, G2): the same results as
``timetable.consecutive_pairs``, ``timetable.bridge_repair`` and
``paths.chain_segments``, but no task holds more than one block of a run.

A run's rows fall into blocks of its week in their own order. Windows work
inside (run, block); what crosses a block's edge (the next block's first row,
the row before, how many rows and breaks came earlier) is exchanged through one
row per block. A run has at most a week of blocks, however many rows it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitrisk.functions.timeops import DAY_S, duration_minutes
from transitrisk.operators.timetable import RUN_KEY, anomalies, pair_columns

BLOCK_S = 3600
_ORDER = ["rel_day", "arr_sod", "dep_sod", "stop"]


def _placed(df: DataFrame, block: Column) -> DataFrame:
    """Adds ``_at`` (run and block): a struct, so a null in a run's key still joins."""
    return df.withColumn("_at", F.struct(*RUN_KEY, block.cast("long").alias("block")))


def _along_run() -> Window:
    return Window.partitionBy(*[f"_at.{c}" for c in RUN_KEY]).orderBy("_at.block")


def _before(c: Column) -> Column:
    """Sum over a run's earlier blocks."""
    return F.coalesce(F.sum(c).over(_along_run().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def consecutive_pairs(stats: DataFrame, block_s: int = BLOCK_S) -> DataFrame:
    """W1 and W2 by blocks of ``block_s`` seconds; rows as of ``timetable.consecutive_pairs``.

    Null days or times come first, as in one window over the run; an empty table
    yields none."""
    s = stats.withColumn("rel_day", F.pmod(F.col("week_day") - F.col("day_start"), F.lit(7)))
    arrival = ["stop", "week_day", "arr_sod", "dep_sod", "rel_day", "mean_delay", "std_delay", "num_delays"]
    arrival += ["delays"] if "delays" in stats.columns else []
    second = F.greatest(F.lit(0), F.least(F.coalesce("arr_sod", F.lit(0)), F.lit(DAY_S - 1)))
    s = _placed(s, F.floor((F.coalesce("rel_day", F.lit(-1)) * DAY_S + second) / block_s))

    row = F.struct(*_ORDER, *[c for c in arrival if c not in _ORDER])
    whole = _along_run().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = (s.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_head"))
             .select("_at", F.lead("_head").over(_along_run()).alias("_after"),
                     F.first("_head").over(whole).alias("_first"), _before(F.col("_n")).alias("_rows")))
    w = Window.partitionBy("_at").orderBy(*_ORDER)
    inner = s.withColumns({"_next": F.lead(row).over(w), "_pos": F.row_number().over(w)}).join(edges, "_at")
    follower = F.coalesce("_next", "_after")
    p = inner.withColumns({"wrap": follower["stop"].isNull(), "pos": (F.col("_rows") + F.col("_pos")).cast("int"),
                           "_to": F.coalesce(follower, F.col("_first"))})
    # a field that is null in the following row is the run's first one, as in the whole window
    return pair_columns(p.withColumns({f"n_{c}": F.coalesce(follower[c], F.col("_first")[c]) for c in arrival}))


def bridge_repair(pairs: DataFrame, bad_stop: str) -> DataFrame:
    """W3 without a window: the next pair of a run is joined by its place, so a run's
    rows spread over all tasks. ``pairs`` number a run's rows 1, 2, … without gaps."""
    run = F.struct(*RUN_KEY)
    arrival = ["arr_node", "arr_day", "arr_sod", "arr_row_dep_sod", "mean_delay", "std_delay", "num_delays"]
    arrival += ["delays"] if "delays" in pairs.columns else []
    touched = F.coalesce((F.col("arr_node") == bad_stop) | (F.col("dep_node") == bad_stop), F.lit(False))
    bad = anomalies(pairs).select(run.alias("_run")).distinct().withColumn("_bad", F.lit(True))
    marked = (pairs.where(touched).withColumn("_run", run).join(bad, "_run", "left")
              .withColumn("_place", F.struct(*RUN_KEY, "pos")))
    follower = pairs.select(F.struct(*RUN_KEY, (F.col("pos") - 1).alias("pos")).alias("_place"),
                            F.struct(*arrival).alias("_to"))
    bridge = F.col("_bad") & (F.col("arr_node") == bad_stop) & F.col("_to").isNotNull()
    repaired = (marked.where(F.col("_bad").isNull() | (F.col("dep_node") != bad_stop) | F.col("dep_node").isNull())
                .join(follower, "_place", "left")
                .withColumns({c: F.when(bridge, F.col("_to")[c]).otherwise(F.col(c)) for c in arrival}))
    out = pairs.where(~touched).unionByName(repaired.select(*pairs.columns))
    out = out.withColumn("day_offset", F.pmod(F.col("arr_day") - F.col("dep_day"), F.lit(7))
                         + F.when(F.col("wrap"), F.lit(7)).otherwise(F.lit(0)))
    return out.withColumn("delta", duration_minutes("dep_sod", "arr_sod", F.col("day_offset")))


def chain_segments(edges: DataFrame, block_s: int = BLOCK_S) -> DataFrame:
    """``seg`` and ``seq`` of ``paths.chain_segments`` by blocks of departure time."""
    e = _placed(edges, F.coalesce(F.floor(F.col("dep_sow") / block_s), F.lit(-1)))
    w = Window.partitionBy("_at").orderBy("dep_sow", "edge_id")
    brk = (F.lag("arr_node").over(w) != F.col("dep_node")) | (F.lag("arr_sow").over(w) > F.col("dep_sow"))
    e = e.withColumns({"_brk": F.coalesce(brk.cast("int"), F.lit(0)), "_row": F.row_number().over(w)})
    end = F.struct("dep_sow", "edge_id", "dep_node", "arr_node", "arr_sow")
    blocks = (e.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"), F.sum("_brk").alias("_breaks"),
                                   F.min(end).alias("_head"), F.max(end).alias("_tail"))
              .withColumn("_prev", F.lag("_tail").over(_along_run())))
    at_edge = (F.col("_prev.arr_node") != F.col("_head.dep_node")) | (F.col("_prev.arr_sow") > F.col("_head.dep_sow"))
    blocks = blocks.withColumn("_edge", F.coalesce(at_edge.cast("int"), F.lit(0)))
    blocks = blocks.select("_at", (_before(F.col("_breaks") + F.col("_edge")) + F.col("_edge")).alias("_segs"),
                           _before(F.col("_n")).alias("_rows"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return (e.withColumn("_in", F.sum("_brk").over(upto)).join(blocks, "_at")
            .withColumns({"seg": F.col("_segs") + F.col("_in"), "seq": (F.col("_rows") + F.col("_row")).cast("int")})
            .drop("_at", "_brk", "_row", "_in", "_segs", "_rows"))
