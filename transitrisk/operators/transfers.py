"""Transfer expansion: the join of a search frontier with the next rides
(J11-J13, P12-P16, F14, F16, W4, W5).

Everything is written in *search direction*: in depart-at mode the search
runs forward in time from the origin; in arrive-by mode it runs backward
from the destination. A ride row is oriented accordingly:

=========  ==========================  ==========================
column     depart                      arrive
=========  ==========================  ==========================
from_node  dep_node                    arr_node
to_node    arr_node                    dep_node
from_abs   dep_sow mod week            arr_sow mod week
from_t     seconds after the query     seconds before the query
to_t       from_t + duration           from_t + duration
=========  ==========================  ==========================

A transfer x → e always uses the delay law of the ride that is earlier
in real time (the label in depart mode, the candidate in arrive mode),
with slack = gap − walk − buffer in whole seconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitrisk.functions.timeops import DAY_S, WEEK_S
from transitrisk.operators.delays import cdf_laws, cdf_of, grid_cells, with_cdf, with_law
from transitrisk.session import write_counted

HOUR_S = 3600
BINS = WEEK_S // HOUR_S
#: Bins of a transfer table that holds all rides of a day, and the half-days of one that is cut off.
WIDE_S = 6 * HOUR_S
HALF_S = DAY_S // 2
HALVES = WEEK_S // HALF_S
#: Bins of rides that may be missed: a transfer looks at some minutes of them.
FINE_S = 300

#: The walking links since a label's ride, in search order.
LINK_TYPE = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("walk_s", T.IntegerType())])
TRAIL_TYPE = T.ArrayType(LINK_TYPE)


@dataclass(frozen=True)
class SearchParams:
    buffer_s: int = 120          # fixed transfer buffer (planner default: 2 minutes)
    cutoff: float = 0.99         # stop scanning a path once a connection is this likely


def orient_rides(rides: DataFrame, mode: str) -> DataFrame:
    """Search-oriented ride rows with a one-hour bin of the search-from time."""
    dep = mode == "depart"
    from_abs = F.pmod(F.col("dep_sow" if dep else "arr_sow"), F.lit(WEEK_S))
    return rides.select(
        "edge_id", "trip_id", "day_start", "seg", "seq", "path_id", "dist_id",
        F.col("dep_node" if dep else "arr_node").alias("from_node"),
        F.col("arr_node" if dep else "dep_node").alias("to_node"),
        from_abs.cast("int").alias("from_abs"),
        (F.col("arr_sow") - F.col("dep_sow")).cast("int").alias("dur"),
        F.floor(from_abs / HOUR_S).cast("int").alias("bin"))


def orient_walks(walks: DataFrame, mode: str) -> DataFrame:
    """Walking links in search direction: a, b, walk_s, and ``more``: whether another link
    leads on from b to a stop other than a."""
    dep = mode == "depart"
    links = walks.select(F.col("dep_node" if dep else "arr_node").alias("a"), F.col("arr_node" if dep else "dep_node").alias("b"),
                         F.col("walk_s").cast("int").alias("walk_s"))
    links = links.groupBy("a", "b").agg(F.min("walk_s").alias("walk_s"))
    on = links.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("_out"))
    back = links.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(1).alias("_back"))
    return (links.join(on, "b", "left").join(back, ["a", "b"], "left")
            .select("a", "b", "walk_s", (F.coalesce("_out", F.lit(0)) > F.coalesce("_back", F.lit(0))).alias("more")))


def rel_times_of(mode: str, t_col: str = "T") -> Column:
    """Seconds between the query and the begin of an oriented ride."""
    t = F.col(t_col)
    return (F.pmod(F.col("from_abs") - t, F.lit(WEEK_S)) if mode == "depart" else F.pmod(t - F.col("from_abs"), F.lit(WEEK_S))).cast("int")


def rel_times(mode: str, t_col: str = "T") -> dict[str, Column]:
    """from_t, to_t and the 24-hour horizon test (P12) of an oriented ride."""
    from_t = rel_times_of(mode, t_col)
    return {"from_t": from_t, "to_t": (from_t + F.col("dur")).cast("int")}


def in_horizon(mode: str, t_col: str = "T") -> Column:
    tsod = F.pmod(F.col(t_col), F.lit(DAY_S))
    same_day = (F.col("from_t") < F.lit(DAY_S) - tsod) if mode == "depart" else (F.col("from_t") <= tsod)
    return (F.col("from_t") > 0) & (same_day | (F.col("to_t") < DAY_S))


def window_bins(mode: str, lo: Column, hi: Column, t_col: str = "T", size: int = HOUR_S) -> Column:
    """Bins of ``size`` seconds (mod one week) covering relative times [lo, hi)."""
    t = F.col(t_col)
    if mode == "depart":
        a, b = t + lo, t + hi - 1
    else:
        a, b = t - hi + 1, t - lo
    return F.transform(F.sequence(F.floor(a / size), F.floor(b / size)),
                       lambda x: F.pmod(x, F.lit(WEEK_S // size)).cast("int"))


def ride_leg(board: Column, alight: Column) -> Column:
    return F.struct(F.lit("ride").alias("kind"), board.cast("long").alias("e1"),
                    alight.cast("long").alias("e2"), F.lit(None).cast("string").alias("wa"),
                    F.lit(None).cast("string").alias("wb"), F.lit(None).cast("int").alias("walk_s"))


def walk_leg(a: Column, b: Column, walk_s: Column) -> Column:
    return F.struct(F.lit("walk").alias("kind"), F.lit(None).cast("long").alias("e1"),
                    F.lit(None).cast("long").alias("e2"), a.alias("wa"), b.alias("wb"),
                    walk_s.cast("int").alias("walk_s"))


def safe_slacks(grids: DataFrame, cutoff: float) -> DataFrame:
    """(dist_id, safe_s): the least slack at which a law's CDF exceeds the
    cut-off; null if it never does within its grid."""
    at = F.array_position(F.transform("grid", lambda p: p > F.lit(cutoff)), F.lit(True))
    return grids.select("dist_id", F.when(at > 0, F.col("lo") + at - 1).cast("int").alias("safe_s"))


def with_key(sr: DataFrame, mode: str, safe: DataFrame | None, buffer_s: int) -> DataFrame:
    """Adds ``key``, the time of week that decides whether a ride is likely enough.

    depart: the departure; rides at or after a label's safe time are.
    arrive: the arrival plus the ride's own safe slack; rides whose key lies at or
    before a label's time are. Rides without a safe slack never are and are left
    out. Without ``safe`` the arrival alone, for labels that any ride reaches in time.
    """
    if mode == "depart" or safe is None:
        return sr.withColumn("key", F.col("from_abs").cast("long"))
    return (sr.join(safe.withColumnRenamed("dist_id", "_did"), F.col("dist_id") == F.col("_did")).drop("_did")
            .where(F.col("safe_s").isNotNull())
            .withColumn("key", (F.col("from_abs") + F.greatest(F.col("safe_s"), F.lit(-buffer_s))).cast("long")).drop("safe_s"))


def mark_front(r: DataFrame, mode: str) -> DataFrame:
    """Adds ``front``: the ride is the first to arrive of its (stop, next stop, path)
    among those likely enough for some label, and ``overtaken``: it is not, because
    of a ride with another key (in depart mode one that leaves later)."""
    dep = mode == "depart"
    ahead = F.col("from_abs") if dep else -F.col("from_abs")
    order = F.struct((ahead + F.col("dur")).alias("end"), ahead.alias("at"), F.col("edge_id"))
    group = ["from_node", "to_node", "path_id"]
    by_key = F.col("key").desc() if dep else F.col("key").asc()
    seen = Window.partitionBy(*group).orderBy(by_key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumns({"_best": F.min(order).over(seen), "_same": F.row_number().over(Window.partitionBy(*group, "key").orderBy(order))})
    front = F.col("_best") == order
    return r.withColumns({"front": front, "overtaken": ~front & (F.col("_same") == 1)}).drop("_best", "_same")


def first_beyond(r: DataFrame, mode: str) -> DataFrame:
    """W5 ends at the first-arriving ride of (stop, next stop, path) that is
    likely enough. Per group and hour bin this is that ride among those
    with a key beyond the bin's edge within a day, so a search looks it up
    instead of joining a day of rides.

    depart: rides with a key at or after the bin's start.
    arrive: rides with a key before the bin's start.
    Columns as ``r`` (rides with their key), with ``bin`` the bin to look up.
    """
    if mode == "depart":
        edges = F.sequence(F.floor((F.col("key") - DAY_S) / HOUR_S) + 1, F.floor(F.col("key") / HOUR_S))
        delta = F.col("from_abs") - F.col("edge")
    else:
        edges = F.sequence(F.floor(F.col("key") / HOUR_S) + 1, F.floor((F.col("key") + DAY_S) / HOUR_S))
        delta = F.col("edge") - F.col("from_abs")
    x = r.withColumn("edge_bin", F.explode(edges)).withColumn("edge", F.col("edge_bin") * HOUR_S)
    order = F.struct(delta + F.col("dur"), delta, F.col("edge_id"))
    cols = [c for c in r.columns if c not in ("bin", "from_node", "to_node", "path_id")]
    return (x.groupBy("from_node", "to_node", "path_id", F.pmod("edge_bin", F.lit(BINS)).cast("int").alias("bin"))
            .agg(F.min_by(F.struct(*cols), order).alias("r"))
            .select("from_node", "to_node", "path_id", "bin", "r.*").select(*r.columns))


# Which rides a key of a transfer joins: all of an hour, all of some minutes, those of an hour that
# are first to arrive for some label, the first to arrive beyond an hour; the last two for any ride in time.
# OVERTAKEN: rides of an hour that arrive after one that leaves later.
# For the transfer table: all of some hours; those that are first for some label, by the ends of half-days.
ALL, FINE, FRONT, BEYOND, ANY_FRONT, ANY_BEYOND, OVERTAKEN, WIDE, SAFE = range(9)


def ride_kinds(sr: DataFrame, mode: str, safe: DataFrame, buffer_s: int) -> DataFrame:
    """The rides as the keys of a transfer join them: ``sr`` with ``kind`` and its bin."""
    key_bin = F.pmod(F.floor(F.col("key") / HOUR_S), F.lit(BINS)).cast("int")
    out = sr.withColumn("kind", F.lit(ALL)).unionByName(
        sr.withColumns({"kind": F.lit(FINE), "bin": F.floor(F.col("from_abs") / FINE_S).cast("int")}))
    for near, far, laws in ((FRONT, BEYOND, safe), (ANY_FRONT, ANY_BEYOND, None))[:1 if mode == "depart" else 2]:
        first = mark_front(with_key(sr, mode, laws, buffer_s), mode).where("front").drop("front", "overtaken")
        out = (out.unionByName(first.withColumns({"kind": F.lit(near), "bin": key_bin}).drop("key"))
               .unionByName(first_beyond(first, mode).withColumn("kind", F.lit(far)).drop("key")))
    return out


# A label is a ride edge reached by a query, or a stop walked to from it: then to_node, to_t and
# from_node are the stop, the time there and the stop before, and ``trail`` holds the links walked.
LABEL_COLS = ["query_id", "T", "target", "threshold", "bound", "edge_id", "virtual", "links", "to_node", "to_t", "from_node",
              "path_id", "trip_id", "day_start", "dist_id", "trail", "best"]


def label_key() -> list:
    """What makes labels the same: the ride, and for a walked stop that and the one before."""
    return ["query_id", "edge_id", "virtual", F.col("links") > 0, "to_node", "from_node"]


def walk_on(labels: DataFrame, sw: DataFrame) -> DataFrame:
    """Labels one walking link further (J12, G6), with ``more``; never straight back."""
    step = F.array(F.struct(F.col("a"), F.col("b"), F.col("walk_s"))).cast(TRAIL_TYPE)
    onward = labels.join(sw, labels.to_node == sw.a).where(F.coalesce(F.col("b") != F.col("from_node"), F.lit(True)))
    moved = {"links": F.col("links") + 1, "to_node": F.col("b"), "to_t": (F.col("to_t") + F.col("walk_s")).cast("int"),
             "from_node": F.col("a"), "trail": F.concat("trail", step)}
    return onward.select(*[moved.get(c, F.col(c)).alias(c) for c in labels.columns], "more")


def walk_labels(frontier: DataFrame, sw: DataFrame) -> DataFrame:
    """Walking labels that another link can extend, within the query's bound."""
    return (walk_on(frontier, sw).where(F.col("more") & (F.col("to_t") <= F.col("bound")) & (F.col("best.prob") > F.col("threshold")))
            .select(*LABEL_COLS))


@dataclass
class Lookups:
    """Per search: safe slacks of the laws, their maximum (None if a law has
    none), and the rides by kind and bin."""
    safe: DataFrame
    most: int | None
    kinds: DataFrame


def lookups(sr: DataFrame, grids: DataFrame, mode: str, params: SearchParams, store=None) -> Lookups:
    """``store`` writes the rides of all kinds and reads them back."""
    safe = safe_slacks(grids, params.cutoff).cache()
    r = safe.agg(F.max("safe_s").alias("m"), F.count_if(F.col("safe_s").isNull()).alias("n")).first()
    kinds = ride_kinds(sr, mode, safe, params.buffer_s)
    return Lookups(safe, r["m"] if r["n"] == 0 else None, store(kinds) if store else kinds.cache())


#: By which a transfer joins the rides.
KIND_KEYS = ["from_node", "bin", "kind"]
KEYS = "array<struct<kind: int, bin: int, likely: boolean>>"


def _keys(kind: int | Column, bins: Column, likely: bool | None) -> Column:
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.transform(bins, lambda x: F.struct(kind.alias("kind"), x.cast("int").alias("bin"), F.lit(likely).cast("boolean").alias("likely"))).cast(KEYS)


def _via_keys(vias: DataFrame, mode: str, params: SearchParams, look: Lookups) -> DataFrame:
    """Explodes (label, via) into the bins to join. ``likely`` tells which rides count there:
    false: all up to the cut-off, in the time in which a ride may be missed; true: those above it, of
    which the first to arrive ends W5: one hour of rides that may be it and one bin to look up beyond,
    or the rides that may be it of the time left, if that is an hour at most."""
    lo, hi, none = F.col("lo"), F.col("hi"), F.array().cast(KEYS)
    ready = F.col("to_t") + F.lit(params.buffer_s)

    def unlikely(end):
        short = end - lo <= HOUR_S
        return (F.when(end <= lo, none).when(short, _keys(FINE, window_bins(mode, lo, end, size=FINE_S), False))
                .otherwise(_keys(ALL, window_bins(mode, lo, end), False)))

    def at(kind, hour):
        return _keys(kind, F.array(F.pmod(hour, F.lit(BINS))), True)

    if mode == "depart":
        safe = look.safe.select(F.col("dist_id").alias("_did"), F.col("safe_s").alias("_safe"))
        vias = vias.join(safe, F.col("dist_id") == F.col("_did"), "left")
        end = (F.when(F.col("dist_id").isNull(), lo).when(F.col("_safe").isNull(), hi)
               .otherwise(F.greatest(lo, ready + F.col("_safe"))))
        hour = F.floor((F.col("T") + end) / HOUR_S)
        near = _keys(FRONT, window_bins(mode, end, hi), True)
        likely = F.when(hi - end <= HOUR_S, near).otherwise(F.concat(at(FRONT, hour), at(BEYOND, hour + 1)))
        keys = F.concat(unlikely(F.least(hi, end)), F.when(end < hi, likely).otherwise(none))
    else:
        # p is 1 for a direct ride into the destination: any ride before the query's time
        plain = F.col("virtual") & (F.col("links") == 0)
        end = hi if look.most is None else F.least(hi, ready + F.lit(max(look.most, -params.buffer_s)))
        hour, last = F.floor((F.col("T") - ready) / HOUR_S), F.floor((F.col("T") - 1) / HOUR_S)
        # a ride's key is its time and its safe slack, which is no less than -buffer; some keys past the first may be missed
        final = hi + params.buffer_s
        near = _keys(FRONT, window_bins(mode, ready, final + 1), True)
        any_near = _keys(ANY_FRONT, window_bins(mode, F.lit(1), hi + 1), True)
        keys = (F.when(plain & (hi <= HOUR_S), any_near).when(plain, F.concat(at(ANY_FRONT, last), at(ANY_BEYOND, last)))
                # a ride at the query's very time is no ride, but could stand for others
                .when(F.col("to_t") <= 0, _keys(ALL, window_bins(mode, lo, hi), None))
                .otherwise(F.concat(unlikely(end), F.when(final - ready <= HOUR_S, near).otherwise(F.concat(at(FRONT, hour), at(BEYOND, hour))))))
    return (vias.withColumn("k", F.explode(keys)).select("*", "k.kind", "k.bin", "k.likely")
            .drop("k", "lo", "hi", *(["_did", "_safe"] if mode == "depart" else [])))


def expand(frontier: DataFrame, sr: DataFrame, sw: DataFrame, grids: DataFrame, mode: str,
           params: SearchParams, cells: int | None = None, tables=None, look: Lookups | None = None,
           few: bool = False) -> DataFrame:
    """One expansion step: frontier labels → best boarding per (query, ride).

    A ride label boards at its stop and one walking link further; a walking
    label has boarded at its stop when it was made and goes one link further.
    Rides are joined only up to the time a connection is safe (W5's cut-off by
    the monotone CDF); of the later ones only those that can end a group are.
    ``few``: the caller has checked that the places to board are few enough to
    be broadcast, so the rides are not shuffled.

    frontier: LABEL_COLS, ``best`` = struct(prob, start_t, nrn, pkey, board, before, via):
    the edge boarded, the edge changed from and the links walked between them.
    Returns (query_id, edge_id, trip_id, day_start, seg, seq, best) for rides
    boarded by a transfer, with W5 (cut-off after the first connection more
    likely than ``params.cutoff`` per (label, via, next stop, path)) applied.
    """
    fr = frontier.select(*LABEL_COLS)
    vias = fr.where(F.col("links") == 0).unionByName(walk_on(fr, sw).drop("more"))
    lo = F.col("to_t")
    hi = F.least(F.lit(DAY_S), F.col("bound") + 1)
    look = look or lookups(sr, grids, mode, params)
    vias = _via_keys(vias.where(lo < hi).withColumns({"lo": lo, "hi": hi}), mode, params, look)
    cands = look.kinds.withColumnsRenamed({
        "edge_id": "c_edge", "trip_id": "c_trip", "day_start": "c_day", "path_id": "c_path",
        "dist_id": "c_dist", "from_node": "c_from", "to_node": "c_to", "seg": "c_seg",
        "seq": "c_seq", "bin": "c_bin", "kind": "c_kind"})
    vias = F.broadcast(vias) if few else vias
    c = vias.join(cands, on=[F.col("to_node") == F.col("c_from"), F.col("bin") == F.col("c_bin"), F.col("kind") == F.col("c_kind")])
    rt = rel_times_of(mode)
    c = c.withColumn("c_from_t", rt).withColumn("c_to_t", (F.col("c_from_t") + F.col("dur")).cast("int"))
    tsod = F.pmod(F.col("T"), F.lit(DAY_S))
    same_day = (F.col("c_from_t") < F.lit(DAY_S) - tsod) if mode == "depart" else (F.col("c_from_t") <= tsod)
    horizon = (F.col("c_from_t") > 0) & (same_day | (F.col("c_to_t") < DAY_S))
    c = c.where(horizon & (F.col("c_from_t") >= F.col("to_t")) & (F.col("c_to_t") <= F.col("bound")))
    # P15 / run rule: never the same vehicle run, never another run of the same path
    other_run = (F.col("virtual") | (F.col("trip_id") != F.col("c_trip"))
                 | (F.col("day_start") != F.col("c_day")))
    other_path = F.col("virtual") | (F.col("path_id") != F.col("c_path"))
    # No immediate return (null-safe for the virtual start label)
    p14 = F.coalesce(F.col("c_to") != F.col("from_node"), F.lit(True))
    c = c.where(other_run & other_path & p14)
    # connection probability
    walked = F.col("links") > 0
    slack = F.col("c_from_t") - F.col("to_t") - F.lit(params.buffer_s)
    if mode == "depart":
        dist = F.col("dist_id")
    else:
        dist = F.when(F.col("virtual") & ~walked, F.lit(None)).otherwise(F.col("c_dist"))
    c = c.withColumns({"_slack": slack.cast("int"), "_dist": dist.cast("string")})
    c = with_cdf(c, grids, "_dist", "_slack", "p", cells, tables)
    c = c.withColumn("nprob", F.col("best.prob") * F.col("p"))
    # rides up to the cut-off end no group: those too unlikely for the query go at once
    likely = F.col("p") > params.cutoff
    c = c.where(F.coalesce(F.col("likely") == likely, F.col("likely").isNull()) & (likely | (F.col("nprob") > F.col("threshold"))))
    # Ordered cut-off per (label, via, next stop, path)
    w = (Window.partitionBy("query_id", "edge_id", "virtual", "links", "to_node", "from_node", "to_t", "c_to", "c_path")
         .orderBy("c_to_t", "c_from_t", "c_edge")
         .rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("_seen", F.max((F.col("p") > params.cutoff).cast("int")).over(w))
    c = c.where((F.coalesce(F.col("_seen"), F.lit(0)) == 0) & (F.col("nprob") > F.col("threshold")))
    # start key: depart = first departure after T (a first walk leaves at T);
    # arrive = time before T of the (re-timed) arrival at the destination
    walk_start = F.lit(0) if mode == "depart" else F.col("c_from_t") - F.col("to_t")
    start = F.when(F.col("virtual"), F.when(walked, walk_start).otherwise(F.col("c_from_t"))) \
        .otherwise(F.col("best.start_t"))
    best = F.struct(F.col("nprob").alias("prob"), start.cast("int").alias("start_t"),
                    (F.col("best.nrn") - 1).cast("int").alias("nrn"),
                    F.xxhash64(F.col("best.pkey"), F.col("c_edge"), F.col("to_node")).alias("pkey"),
                    F.col("c_edge").cast("long").alias("board"),
                    F.when(~F.col("virtual"), F.col("edge_id")).cast("long").alias("before"), F.col("trail").alias("via"))
    c = c.select("query_id", F.col("c_edge").alias("edge_id"), F.col("c_trip").alias("trip_id"),
                 F.col("c_day").alias("day_start"), F.col("c_seg").alias("seg"),
                 F.col("c_seq").alias("seq"), best.alias("best"), "T", "target", "threshold", "bound")
    return (c.groupBy("query_id", "edge_id")
            .agg(F.max("best").alias("best"), F.first("trip_id").alias("trip_id"),
                 F.first("day_start").alias("day_start"), F.first("seg").alias("seg"),
                 F.first("seq").alias("seq"), F.first("T").alias("T"), F.first("target").alias("target"),
                 F.first("threshold").alias("threshold"), F.min("bound").alias("bound")))


def stay_aboard(boardings: DataFrame, sr: DataFrame, mode: str) -> DataFrame:
    """Propagates each boarding along its vehicle run (probability unchanged):
    every later edge of the run (in search direction) takes the best of the
    boardings before it. The boardings are read once, and their copies along
    the run are aggregated before the shuffle. Returns LABEL_COLS rows.
    """
    asc = mode == "depart"
    b = boardings.select("query_id", "trip_id", "day_start", "seg", F.col("seq").alias("_bseq"), "best", "T", "target", "threshold", "bound")
    run = b.join(sr.drop("bin"), on=["trip_id", "day_start", "seg"]).withColumns(rel_times(mode))
    run = run.where(in_horizon(mode) & (F.col("to_t") <= F.col("bound"))
                    & ((F.col("seq") >= F.col("_bseq")) if asc else (F.col("seq") <= F.col("_bseq"))))
    same = ["query_id", "T", "target", "threshold", "edge_id", "to_node", "to_t", "from_node", "path_id", "trip_id", "day_start", "dist_id"]
    u = run.groupBy(*same).agg(F.max("best").alias("best"), F.min("bound").alias("bound"))
    return u.withColumns({"virtual": F.lit(False), "links": F.lit(0), "trail": F.array().cast(TRAIL_TYPE)}).select(*LABEL_COLS)


#: Pairs that a task of the transfer table makes.
PAIRS_PER_TASK = 200_000_000


def _pairs(v: DataFrame, e: DataFrame, *more: Column) -> DataFrame:
    """Joins vias and rides on (stop, kind, bin), and on ``more`` conditions. Tasks are dealt by the pairs they
    look at, not by the rows they read, which say little here; a stop and bin of too many pairs is cut in slices."""
    # kind and bin in one column: the planner drops a constant kind from the keys, and with it the dealing
    on, slots = ["e_dep", "e_slot"], 2 * WEEK_S // FINE_S
    v = v.withColumns({"e_slot": F.col("kind") * slots + F.col("bin"), "e_dep": F.col("via")}).drop("kind", "bin")
    e = e.withColumn("e_slot", F.col("e_kind") * slots + F.col("e_bin")).drop("e_kind", "e_bin")
    n = v.groupBy(*on).agg(F.count(F.lit(1)).alias("_v")).join(e.groupBy(*on).agg(F.count(F.lit(1)).alias("_e")), on)
    made = n.agg(F.sum(F.col("_v").cast("double") * F.col("_e")).alias("all"), F.max(F.col("_v").cast("double") * F.col("_e")).alias("most")).first()
    tasks, slices = int((made["all"] or 0) // PAIRS_PER_TASK) + 1, int((made["most"] or 0) // PAIRS_PER_TASK) + 1
    if slices > 1:
        v = v.withColumn("_slice", F.pmod(F.xxhash64("x_edge", "xa", "walk_s"), F.lit(slices)).cast("int"))
        e = e.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        on = [*on, "_slice"]
    if tasks > int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        v, e = v.repartition(tasks, *on), e.repartition(tasks, *on)
    v, e = v.withColumnsRenamed({c: f"v_{c}" for c in on}), e
    keys = [F.col(f"v_{c}") == F.col(c) for c in on]
    return v.join(e, [*keys, *more]).drop(*[f"v_{c}" for c in on], *on)


def _bins(a: Column, b: Column, size: int = HOUR_S) -> Column:
    return F.transform(F.sequence(F.floor(a / size), F.floor(b / size)), lambda x: F.pmod(x, F.lit(WEEK_S // size)))


def transfer_table(rides: DataFrame, walks: DataFrame | None, grids: DataFrame,
                   params: SearchParams = SearchParams(), direct: bool = True,
                   cutoff: bool = True) -> DataFrame:
    """Query-independent transfer pairs x → (walk) → e.

    e departs within 24 h after x arrives (plus the walk), from x's arrival
    stop or a stop walkable from it; never the same run, never another run
    of the same path, no immediate return. The join key is (stop, some hours of
    the week), so a hub stop is spread over them, and over slices of them if large. ``cutoff`` keeps, per
    (x, via stop, next stop, path), the candidates up to and including the
    first with probability above ``params.cutoff`` (forward order): see ``_up_to_safe``,
    and ``_up_to_cutoff`` for the vias and rides it leaves. Rides and grids are written
    once, in the shared folder; the pairs themselves are not shuffled.
    """
    rides, _ = write_counted(rides, "transfer-rides")
    grids, _ = write_counted(grids, "transfer-grids")
    laws, points = cdf_laws(grids)
    cells = grid_cells(grids)
    x = rides.select(F.col("edge_id").alias("x_edge"), F.col("trip_id").alias("x_trip"),
                     F.col("day_start").alias("x_day"), F.col("path_id").alias("x_path"),
                     F.col("dep_node").alias("x_dep"), F.col("arr_node").alias("x_arr"),
                     F.pmod("arr_sow", F.lit(WEEK_S)).alias("xa"), F.col("dist_id").alias("x_dist"))
    x = with_law(x, laws, "x_dist")
    parts = []
    if direct:
        parts.append(x.select("*", F.col("x_arr").alias("via"), F.lit(0).alias("walk_s"),
                              F.lit(None).cast("string").alias("prev_node")))
    if walks is not None:
        w = walks.select(F.col("dep_node").alias("_wa"), F.col("arr_node").alias("via"),
                         F.col("walk_s").cast("int").alias("walk_s"), "prev_node")
        parts.append(x.join(w, x.x_arr == w._wa).where(F.col("via") != F.col("x_dep")).drop("_wa"))
    v = parts[0]
    for p in parts[1:]:
        v = v.unionByName(p)
    # the stop not to return to: the last one left, by ride or on foot
    v = v.where(F.col("walk_s") <= DAY_S).withColumn("x_not", F.when(F.col("prev_node").isNotNull(), F.col("prev_node")).otherwise(F.col("x_dep"))).drop("x_dep", "x_arr", "prev_node")
    e = orient_rides(rides if "seg" in rides.columns else rides.withColumns({"seg": F.lit(0), "seq": F.lit(0)}), "depart")
    if not cutoff:
        v = v.withColumn("bin", F.explode(_bins(F.col("xa") + F.col("walk_s"), F.col("xa") + F.lit(DAY_S), WIDE_S))).withColumn("kind", F.lit(WIDE))
        e = e.withColumns({"kind": F.lit(WIDE), "bin": F.floor(F.col("from_abs") / WIDE_S).cast("int")})
        j = _allowed(v.drop("x_dist"), e, params.buffer_s)
        return cdf_of(j, points, cells, "slack").select(*TRANSFER_COLS)
    safe = safe_slacks(grids, params.cutoff)
    v = v.join(F.broadcast(safe.withColumnsRenamed({"dist_id": "_did", "safe_s": "_safe"})), F.col("x_dist") == F.col("_did"), "left").drop("_did")
    dur = F.col("arr_sow") - F.col("dep_sow")
    r = rides.agg(F.max(dur).alias("most"), F.count_if(F.coalesce(dur, F.lit(-1)) < 0).alias("bad")).first()
    longest = r["most"] or 0
    lo, hi = F.col("xa") + F.col("walk_s"), F.col("xa") + F.lit(DAY_S)
    ready = F.greatest(lo, lo + F.lit(params.buffer_s) + F.col("_safe"))
    end = F.when(F.col("x_dist").isNull(), lo).when(F.col("_safe").isNull(), hi + 1).otherwise(F.least(hi + 1, ready))
    v = v.withColumn("_end", end).withColumn("_odd", F.lit(r["bad"] > 0) | F.col("_safe").isNull() | (F.col("_end") + F.lit(HALF_S + longest) > hi)).drop("_safe", "x_dist")
    twice = rides.groupBy("edge_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or edge_id is null").select(F.col("edge_id").alias("_twice"))
    if not twice.isEmpty():
        # a ride's rows share a group, whatever their stops; of equal ones to board, one
        v = v.join(twice, F.col("x_edge").eqNullSafe(F.col("_twice")), "left").withColumn("_odd", F.col("_odd") | F.col("x_edge").isNull() | F.col("_twice").isNotNull()).drop("_twice")
        e_once = e.dropDuplicates(["edge_id", "from_node", "to_node", "path_id", "from_abs", "dur"])
    else:
        e_once = e
    out = _up_to_safe(v.where(~F.col("_odd")).drop("_odd"), e_once, points, cells, params)
    odd = v.where("_odd").drop("_odd")
    return out if odd.isEmpty() else out.unionByName(_up_to_cutoff(odd, e, safe, points, cells, longest, params))


TRANSFER_COLS = ["x_edge", "e_edge", "via", "walk_s", "gap", "slack", "p"]


def _allowed(v: DataFrame, e: DataFrame, buffer_s: int, *more: Column) -> DataFrame:
    """Pairs of vias and rides that a transfer may make, with ``gap`` and ``slack``."""
    e = e.select(F.col("edge_id").alias("e_edge"), F.col("trip_id").alias("e_trip"), F.col("day_start").alias("e_day"),
                 F.col("path_id").alias("e_path"), F.col("from_node").alias("e_dep"), F.col("to_node").alias("e_arr"),
                 F.col("from_abs").alias("ed"), F.col("dur").alias("e_dur"), F.col("bin").alias("e_bin"), F.col("kind").alias("e_kind"),
                 *[c for c in e.columns if c.startswith("u_")])
    j = _pairs(v, e, *more)
    gap = F.when(F.col("ed") >= F.col("xa"), F.col("ed") - F.col("xa")).otherwise(F.col("ed") - F.col("xa") + F.lit(WEEK_S))
    j = j.withColumn("gap", gap.cast("int"))
    j = j.where((F.col("gap") >= F.col("walk_s")) & (F.col("gap") <= DAY_S)
                & ((F.col("x_trip") != F.col("e_trip")) | (F.col("x_day") != F.col("e_day")))
                & (F.col("x_path") != F.col("e_path")) & (F.col("e_arr") != F.col("x_not")))
    return j.withColumn("slack", (F.col("gap") - F.col("walk_s") - F.lit(buffer_s)).cast("int"))


def _up_to_safe(v: DataFrame, e: DataFrame, points: DataFrame, cells: int, params: SearchParams) -> DataFrame:
    """W5's pairs without comparing pairs: of a (via, next stop, path) the ride that ends it is looked up
    by the time from which rides are likely enough, and of those before it each knows until when one that
    leaves later overtakes it. For vias likely half a day before the longest ride could pass their last time."""
    safe = _first_and_overtaken(e)
    ready, lo = F.col("_end"), F.col("xa") + F.col("walk_s")
    cut = (F.floor(ready / HALF_S) + 1) * HALF_S
    none = F.array().cast(KEYS)
    before = (F.when(ready <= lo, none).when(ready - lo <= HOUR_S, _keys(FINE, _bins(lo, ready - 1, FINE_S), False))
              .otherwise(_keys(ALL, _bins(lo, ready - 1), False)))
    v = v.withColumns({"t_off": ready - cut, "h_off": F.col("xa") + F.lit(DAY_S) - cut, "need": ready - F.col("xa"),
                       "k": F.explode(F.concat(before, _keys(SAFE, F.array(F.pmod(cut / HALF_S, F.lit(HALVES))), True)))})
    v = v.select("*", "k.kind", "k.bin").drop("k", "_end")
    first = safe.where("u_t_hi is not null").withColumn("kind", F.lit(SAFE))
    own = safe.where("u_over is not null").withColumns({c: F.lit(None).cast("long") for c in ("u_t_lo", "u_t_hi", "u_h_lo", "u_h_hi")})
    e = (first.unionByName(own.withColumns({"kind": F.lit(ALL), "bin": F.floor(F.col("from_abs") / HOUR_S)}))
         .unionByName(own.withColumns({"kind": F.lit(FINE), "bin": F.floor(F.col("from_abs") / FINE_S)})))
    is_first = F.col("u_t_hi").isNotNull()
    j = _allowed(v, e, params.buffer_s, ~is_first | ((F.col("u_t_lo") < F.col("t_off")) & (F.col("t_off") <= F.col("u_t_hi"))
                                                     & (F.col("u_h_lo") < F.col("h_off")) & (F.col("h_off") <= F.col("u_h_hi"))))
    j = j.where(F.when(is_first, F.col("gap") >= F.col("need")).otherwise(F.col("gap") + F.col("u_over") < F.col("need")))
    return cdf_of(j, points, cells, "slack").select(*TRANSFER_COLS)


def _first_and_overtaken(e: DataFrame) -> DataFrame:
    """Rides of the week by the half-days' ends (``bin``) for ``_up_to_safe``, written once.

    Seconds are told from such an end. In the half-day before it, a ride that none leaving with or after it
    beats is first for the seconds since the one before (``u_t_lo`` < second <= ``u_t_hi``). Seconds past the last of
    these are left to the day after: there the best ride up to a last time is first for the last times until a
    better one leaves (``u_h_lo`` < time <= ``u_h_hi``). ``u_over``, of the half-day's rides: seconds from its departure to
    the last one of a ride that arrives before it, 0 at least.
    """
    e = e.where(F.col("from_node").isNotNull() & F.col("to_node").isNotNull() & F.col("path_id").isNotNull() & F.col("from_abs").isNotNull())
    half = F.floor(F.col("from_abs") / HALF_S)
    r = e.withColumn("_c", F.explode(F.array(half + 1, half, half - 1))).drop("bin", "seg", "seq", "dist_id")
    r = r.withColumns({"_off": F.col("from_abs") - F.col("_c") * HALF_S, "bin": F.pmod("_c", F.lit(HALVES)).cast("int")}).drop("_c")
    r = r.withColumn("_key", F.struct((F.col("_off") + F.col("dur")).alias("end"), F.col("_off").alias("off"), "edge_id"))
    part = Window.partitionBy("from_node", "to_node", "path_id", "bin")
    before, after = (Window.unboundedPreceding, Window.currentRow), F.col("_off") >= 0
    late, early, arrived = part.orderBy(F.col("_off").desc(), "_key"), part.orderBy("_off", "_key"), part.orderBy("_key")
    r = r.withColumns({"_first": ~after & (F.min("_key").over(late.rowsBetween(*before)) == F.col("_key")),
                       "_best": after & (F.min(F.when(after, F.col("_key"))).over(early.rowsBetween(*before)) == F.col("_key")),
                       "_over": F.max("_off").over(arrived.rowsBetween(Window.unboundedPreceding, -1)) - F.col("_off")})
    first, best = F.when(F.col("_first"), F.col("_off")), F.when(F.col("_best"), F.col("_off"))
    r = r.withColumns({"_since": F.max(first).over(early.rowsBetween(Window.unboundedPreceding, -1)),
                       "_until": F.min(best).over(early.rowsBetween(1, Window.unboundedFollowing)), "_last": F.max(first).over(part)})
    start = F.lit(-HALF_S - 1)
    r = r.withColumns({"u_t_lo": F.coalesce(F.when(~after, F.col("_since")).otherwise(F.col("_last")), start),
                       "u_t_hi": F.when(F.col("_first"), F.col("_off")).when(F.col("_best"), F.lit(0)),
                       "u_h_lo": F.when(after, F.col("_off") - 1).otherwise(F.lit(-1)),
                       "u_h_hi": F.coalesce(F.when(after, F.col("_until") - 1), F.lit(DAY_S)),
                       "u_over": F.when(~after, F.greatest(F.col("_over"), F.lit(0)))})
    # an equal ride before it has the whole stretch
    r = r.withColumn("u_t_hi", F.when((F.col("u_t_lo") < F.col("u_t_hi")) & (F.col("u_h_lo") < F.col("u_h_hi")), F.col("u_t_hi")))
    r = r.where("u_t_hi is not null or u_over is not null").drop("_off", "_key", "_first", "_best", "_over", "_since", "_until", "_last")
    return write_counted(r.withColumns({c: F.col(c).cast("long") for c in ("u_t_lo", "u_t_hi", "u_h_lo", "u_h_hi", "u_over")}), "transfer-first")[0]


def _up_to_cutoff(v: DataFrame, oriented: DataFrame, safe: DataFrame, points: DataFrame, cells: int, longest: int,
                  params: SearchParams) -> DataFrame:
    """W5's pairs by comparing those of a (x, via stop, next stop, path): all rides up to the safe time, and of
    the later ones those that can be the first to arrive: of the next hour, looked up beyond it, and overtaken
    ones at the end of the day, where the faster may be out of reach."""
    lo, hi, end, none = F.col("xa") + F.col("walk_s"), F.col("xa") + F.lit(DAY_S), F.col("_end"), F.array().cast(KEYS)
    hour = F.floor(end / HOUR_S)
    unlikely = (F.when(end <= lo, none).when(end - lo <= HOUR_S, _keys(FINE, _bins(lo, end - 1, FINE_S), False))
                .otherwise(_keys(ALL, _bins(lo, end - 1), False)))
    first = F.concat(_keys(FRONT, _bins(end, end), True), _keys(BEYOND, F.array(F.pmod(hour + 1, F.lit(BINS))), True))
    # where a ride that overtakes leaves after the last time, the overtaken one counts
    late = _keys(OVERTAKEN, _bins(F.greatest(end, hi - F.lit(longest)), hi), True)
    v = v.withColumn("k", F.explode(F.concat(unlikely, F.when(end <= hi, F.concat(first, late)).otherwise(none)))).drop("_end")
    v = v.select("*", "k.kind", "k.bin", "k.likely").drop("k")
    marked = mark_front(with_key(oriented, "depart", safe, params.buffer_s), "depart").drop("key").where("overtaken").drop("front", "overtaken")
    e = ride_kinds(oriented, "depart", safe, params.buffer_s).unionByName(marked.withColumn("kind", F.lit(OVERTAKEN)))
    j = cdf_of(_allowed(v, e, params.buffer_s), points, cells, "slack")
    j = j.where((F.col("likely") == (F.col("p") > params.cutoff)) | (F.col("p").isNull() & ~F.col("likely")))
    w5 = (Window.partitionBy("x_edge", "via", "e_arr", "e_path")
          .orderBy(F.col("gap") + F.col("e_dur"), "gap", "e_edge")
          .rowsBetween(Window.unboundedPreceding, -1))
    # equal rides follow each other; one stays
    again = F.struct("e_edge", "walk_s", "gap")
    j = (j.withColumns({"_seen": F.max((F.col("p") > params.cutoff).cast("int")).over(w5),
                        "_again": F.max(again).over(w5.rowsBetween(-1, -1)).eqNullSafe(again)})
         .where((F.coalesce(F.col("_seen"), F.lit(0)) == 0) & ~F.col("_again")))
    return j.select(*TRANSFER_COLS)


def horizon_rides(q: DataFrame, sr: DataFrame, mode: str) -> DataFrame:
    """Rides leaving each query's start stop inside its 24-hour horizon (P12),
    joined on (stop, hour-of-week bin). q: query_id, T, start."""
    lo, hi = F.lit(1), F.lit(DAY_S)
    qb = q.withColumn("bin", F.explode(window_bins(mode, lo, hi)))
    j = qb.join(sr.withColumnRenamed("bin", "r_bin"),
                (qb.start == sr.from_node) & (qb.bin == F.col("r_bin")))
    j = j.withColumns(rel_times(mode))
    return j.where(in_horizon(mode)).drop("bin", "r_bin")


#: Queries of first rides up to which they are broadcast, and stretches of a (group, day) looked up by the day.
BROADCAST_ASKED = 250_000
FEW_A_DAY = 16


def seed_rides(q: DataFrame, sr: DataFrame, mode: str) -> DataFrame:
    """First ride per (query, next stop, path) from the start stop (J13, W4,
    A15): ordered by arrival (depart) or by departure, latest first (arrive).

    Per (stop, next stop, path) and day of the search's clock, only the rides that are
    best for some second are kept, each with the stretch of seconds it is best for, and
    a query looks up the one stretch it lies in: nothing of the size of queries times
    groups, which is that of the result, is shuffled. Two rides compete: the best one
    left of the query's day, and the best one of the day after if it ends within 24 hours.
    """
    def clock(c):
        at = F.pmod(F.col(c).cast("long"), F.lit(WEEK_S))
        return at if mode == "depart" else F.lit(WEEK_S - 1) - at

    group = ["from_node", "to_node", "path_id"]
    cols = [c for c in sr.columns if c not in ("bin", *group)]
    r = sr.where(F.col("from_node").isNotNull() & F.col("from_abs").isNotNull()).withColumn("_s", clock("from_abs"))
    r = r.withColumn("_day", F.floor(F.col("_s") / DAY_S))

    def ride(shift):
        s = F.col("_s") + F.lit(shift)
        return F.struct((s + F.col("dur")).alias("end"), s.alias("s"), *[F.col(c) for c in ["edge_id", *[c for c in cols if c != "edge_id"]]])

    none = F.lit(None).cast(r.select(ride(0).alias("x")).schema["x"].dataType)
    today = r.select(*group, "_day", F.col("_s").alias("_hi"), ride(0).alias("a"), none.alias("b"))
    # seen from the day before: after that day's end; Monday's follow Sunday's
    morrow = F.when(F.col("_day") == 0, ride(WEEK_S)).otherwise(ride(0))
    after = (r.where(F.col("dur").isNotNull()).groupBy(*group, F.pmod(F.col("_day") - 1, F.lit(7)).alias("_day")).agg(F.min(morrow).alias("b"))
             .select(*group, "_day", F.lit(WEEK_S).cast("long").alias("_hi"), none.alias("a"), "b"))
    # latest first; a ride stays if none that leaves with or after it is better, for the seconds since the one before it
    run = Window.partitionBy(*group, "_day").orderBy(F.col("_hi").desc(), "a")
    seen = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = (today.unionByName(after).withColumns({"_best": F.min("a").over(seen), "b": F.max("b").over(seen)})
            .where(F.col("a").isNull() | F.col("a").eqNullSafe(F.col("_best"))).drop("_best")
            .withColumns({"_lo": F.coalesce(F.lead("_hi").over(run), F.lit(-1)), "_n": F.count(F.lit(1)).over(Window.partitionBy(*group, "_day"))})
            .where(F.col("_lo") < F.col("_hi")))
    # stretches of few a day are looked up by the day, those of many by the hour
    start = F.greatest(F.col("_lo"), F.col("_day") * DAY_S)
    hours = F.sequence(F.floor(start / HOUR_S), F.floor((F.least(F.col("_hi"), (F.col("_day") + 1) * DAY_S) - 1) / HOUR_S))
    best = best.withColumn("_slot", F.explode(F.when(F.col("_n") <= FEW_A_DAY, F.array(-1 - F.col("_day"))).otherwise(hours))).drop("_n", "_day")
    asked = q.withColumns({"_q": F.struct(*[F.col(c) for c in q.columns]), "_at": clock("T")})
    n = asked.groupBy("query_id").count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
    asked = asked.select("_q", F.col("start").alias("_start"), "_at", F.explode(F.array(
        -1 - F.floor(F.col("_at") / DAY_S), F.floor(F.col("_at") / HOUR_S))).alias("_ask"))
    asked = F.broadcast(asked) if (n["all"] or 0) <= BROADCAST_ASKED else asked
    x = best.join(asked, (F.col("_start") == F.col("from_node")) & (F.col("_ask") == F.col("_slot"))
                  & (F.col("_lo") <= F.col("_at")) & (F.col("_at") < F.col("_hi")))
    b = F.when(F.col("b.end") - F.col("_at") < DAY_S, F.col("b"))
    x = x.withColumn("r", F.least("a", b)).where(F.col("r").isNotNull())
    h = x.select("_q.*", *[F.col("r")[c].alias(c) if c in cols else F.col(c) for c in sr.columns if c != "bin"]).withColumns(rel_times(mode))
    if (n["most"] or 0) <= 1:
        return h  # one query an id: its groups are all different
    first = Window.partitionBy("query_id", "to_node", "path_id").orderBy("to_t", "from_t", "edge_id")
    return h.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")
