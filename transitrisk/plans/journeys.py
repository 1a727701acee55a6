"""Batch journey planning as DataFrame rounds (G1, G2, G4-G8, J12, W6, A15, A16,
J9, J13, J14, P17, F15, F19, O1, U4).

A label is a ride edge reached by a query with a path probability, or a stop
walked to from one. Round k boards one more vehicle and walks one more link:
frontier ⋈ links ⋈ rides on (stop, hour bin) → connection probability → W5
cut-off → best boarding per (query, edge) → propagation along the vehicle run
→ keep strict improvements. Chains of walking links grow by a link a round,
within the query's bound, so no table of all walkable pairs is needed. The
max-product recursion over time-ordered edges does not depend on the visiting
order, so the rounds reach the same labels as a best-first search. Per query,
labels later than the best arrival found so far are pruned (exact: times only
grow along a path). A search runs in passes of growing time bounds, the first
so short that a query can finish only some rides in it, however many the
timetable holds; a query leaves with the pass that answers it.

A label holds no history, only the edge boarded, the edge changed from and the
links between them. Itineraries follow these pointers back from the answers, so
histories exist for answers only.

Nothing is collected to the driver except the row count of each round's
improvements; each round is one written table in the shared folder. What
depends on the timetable alone (oriented rides, links, the rides to look up
beyond a bin, CDF tables) is prepared once per timetable and mode.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitrisk.functions.timeops import DAY_S, WEEK_S, format_hms, hhmm_to_sod, is_hms, sow, today_weekday
from transitrisk.operators.delays import cdf_tables, grid_cells
from transitrisk.operators.paths import chain_segments, run_paths
from transitrisk.operators.transfers import (HOUR_S, KIND_KEYS, LABEL_COLS, TRAIL_TYPE, Lookups, SearchParams, expand, label_key, lookups,
                                              orient_rides, orient_walks, ride_leg, stay_aboard, walk_labels, walk_leg,
                                              walk_on)
from transitrisk.session import dealt, shuffles_removed, small_job, write_counted

INF = 10 * WEEK_S


@dataclass
class Prepared:
    """What a search of one mode needs of a timetable."""
    rides: DataFrame
    links: DataFrame
    cells: int
    tables: tuple[DataFrame, DataFrame]
    look: Lookups
    most_links: int  # that leave one stop
    is_dealt: bool = False

    def deal(self) -> "Prepared":
        """Deals the rides once by what a search's rounds join them by, so that no round moves
        the timetable. Left to the first search: a mode may never be asked for."""
        if not self.is_dealt:
            rides, kinds = self.rides, self.look.kinds
            with shuffles_removed(rides.sparkSession):
                self.rides, self.look.kinds = dealt(rides, "trip_id", "day_start", "seg"), dealt(kinds, *KIND_KEYS)
            kinds.unpersist()
            self.is_dealt = True
        return self


@dataclass
class Timetable:
    """rides: edge_id, trip_id, day_start, seg, seq, path_id, dep_node, arr_node,
    dep_sow, arr_sow, dist_id; walks: walking links (dep_node, arr_node, walk_s); grids: CDF grids."""
    rides: DataFrame
    walks: DataFrame
    grids: DataFrame
    store: object = None  # writes the rides as transfers of a mode join them, and reads them back
    _prepared: dict = field(default_factory=dict, repr=False)
    _durations: tuple | None = field(default=None, repr=False)

    def short_bounds(self, most: int, rides: int, stops: int = 0) -> list[int]:
        """Ascending time bounds below ``most``, each twice the one before, in which a query can
        finish ``rides`` rides from one stop on average, and from ``stops`` times the number of
        stops if that is more. None for a timetable too sparse."""
        if self._durations is None:
            by_minute = (self.rides.select(F.floor((F.col("arr_sow") - F.col("dep_sow")) / 60).cast("int").alias("m"))
                         .where(F.col("m").between(0, DAY_S // 60)).groupBy("m").count().collect())
            n_stops = known_stops(self.rides, self.walks, "dep_node").count()
            self._durations = tuple((60 * r["m"], r["count"]) for r in by_minute), n_stops
        by_duration, n_stops = self._durations
        need = max(rides, stops * n_stops) * WEEK_S * n_stops
        out, bound = [], int(most) // 2
        while bound > 0 and sum(n * max(0, bound - d) for d, n in by_duration) >= need > 0:
            out.insert(0, bound)
            bound //= 2
        return out

    def prepared(self, mode: str, params: "SearchParams") -> Prepared:
        """Built once per mode and parameters, when a search first asks for it, and kept for all later ones."""
        key = (mode, params)
        if key not in self._prepared:
            sr = orient_rides(self.rides, mode)
            bounds, points = cdf_tables(self.grids)
            links = orient_walks(self.walks, mode).cache()
            most = links.groupBy("a").count().agg(F.max("count")).first()[0] or 0
            with shuffles_removed(self.rides.sparkSession):
                look = lookups(sr, self.grids, mode, params, self.store)
            self._prepared[key] = Prepared(sr, links, grid_cells(self.grids), (bounds.cache(), points.cache()), look, most)
        return self._prepared[key]


def build_timetable(spark, rides: DataFrame, stops: DataFrame, dists: DataFrame,
                    walk_max_m: float = 500.0, speed_mps: float = 1.0) -> "Timetable":
    """Materialises the search inputs once (S4) and reads them back (S5):
    rides (already prepared), the walking links between stops within
    ``walk_max_m``, the CDF grids of the delay laws; and, when a mode is first searched, the rides as
    its transfers join them."""
    from transitrisk.operators.delays import cdf_grids
    from transitrisk.operators.walks import walk_pairs
    from transitrisk.session import scratch_path
    from transitrisk.sources.storage import read_stage, write_stage
    walks = walk_pairs(stops, walk_max_m, speed_mps).select("dep_node", "arr_node", F.col("walk_s").cast("int").alias("walk_s"))
    grids = cdf_grids(dists)
    base = scratch_path(spark, "timetable")
    out = {}
    for name, df in (("rides", rides), ("walks", walks), ("grids", grids)):
        with shuffles_removed(spark):
            out[name] = read_stage(spark, write_stage(df, f"{base}/{name}")).cache()
    return Timetable(out["rides"], out["walks"], out["grids"],
                     lambda kinds: read_stage(spark, write_stage(kinds, scratch_path(spark, "timetable-kinds"))))


def prepare_rides(edges: DataFrame, dist_col: str = "dist_id") -> DataFrame:
    """Adds run stretches (seg, seq) and the path key when missing."""
    e = edges
    if "path_id" not in e.columns:
        paths = run_paths(e)
        e = e.join(paths.select("trip_id", "day_start", "path_id"), ["trip_id", "day_start"], "left")
    e = chain_segments(e)
    return e.select("edge_id", "trip_id", "day_start", "seg", "seq", "path_id", "dep_node",
                    "arr_node", F.col("dep_sow").cast("int"), F.col("arr_sow").cast("int"),
                    F.col(dist_col).cast("string").alias("dist_id"))


def _virtual_labels(q: DataFrame) -> DataFrame:
    no_trail = F.array().cast(TRAIL_TYPE)
    best = F.struct(F.lit(1.0).alias("prob"), F.lit(0).alias("start_t"), F.lit(0).alias("nrn"),
                    F.lit(0).cast("long").alias("pkey"), F.lit(None).cast("long").alias("board"),
                    F.lit(None).cast("long").alias("before"), no_trail.alias("via"))
    return q.select("query_id", "T", "target", "threshold", "bound",
                    F.lit(-1).cast("long").alias("edge_id"), F.lit(True).alias("virtual"), F.lit(0).alias("links"),
                    F.col("start").alias("to_node"), F.lit(0).alias("to_t"),
                    F.lit(None).cast("string").alias("from_node"),
                    F.lit(None).cast("long").alias("path_id"),
                    F.lit(None).cast("long").alias("trip_id"),
                    F.lit(None).cast("int").alias("day_start"),
                    F.lit(None).cast("string").alias("dist_id"), no_trail.alias("trail"), best.alias("best"))


def _target_arrivals(labels: DataFrame, q: DataFrame, sw: DataFrame) -> DataFrame:
    """Every way a query's labels reach its target: riding in, or walking the
    last link from a ride, a walked stop or the start."""
    at_target = F.col("to_node") == F.col("target")
    arrivals = labels.where(at_target & (F.col("links") == 0)).unionByName(
        walk_on(labels.unionByName(_virtual_labels(q)), sw).drop("more").where(at_target))
    th = q.select("query_id", F.col("threshold").alias("_th"))
    return (arrivals.select("query_id", F.col("to_t").alias("arr_t"), "best", "edge_id", "virtual", "trail").join(th, "query_id")
            .where(F.col("best.prob") > F.col("_th")).drop("_th"))


def search(q: DataFrame, tt: Timetable, mode: str, params: SearchParams = SearchParams(),
           to_target: bool = True, made: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs the rounds for queries q(query_id, T, start, target, threshold, bound). ``made`` takes the
    number of labels of each round.

    Returns (labels, q). Only strict improvements go on, so the rounds end by
    themselves. Each round is one job that writes and counts the improved
    labels; the per-query bound (best target arrival so far) rides along in the
    label rows, so no other table is rewritten per round. Earlier labels are
    compared by key and rank only.
    """
    use = tt.prepared(mode, params).deal()
    sr, sw = use.rides, use.links
    q, n_queries = write_counted(q, "search-queries")
    frontier, n_frontier = _virtual_labels(q), n_queries
    spark = q.sparkSession
    pieces: list[DataFrame] = []
    rank = F.struct(*[F.col(f"best.{c}") for c in ("prob", "start_t", "nrn", "pkey")], (-F.col("to_t")).alias("early"))
    slim = [c for c in LABEL_COLS if c in ("query_id", "edge_id", "virtual", "links", "to_node", "from_node")]
    while True:
        # a label boards at its stop and one link further, in the bins of a day
        few = n_frontier * (1 + use.most_links) * (DAY_S // HOUR_S + 2) <= BROADCAST_PLACES
        boardings = expand(frontier, sr, sw, tt.grids, mode, params, use.cells, use.tables, use.look, few)
        cand = (stay_aboard(boardings, sr, mode).select(*LABEL_COLS).unionByName(walk_labels(frontier, sw))
                .withColumn("_rank", rank))
        if pieces:
            old = _union([p.select(*slim, rank.alias("_rank")) for p in pieces]).withColumn("_old", F.col("_rank"))
            u = cand.unionByName(old, allowMissingColumns=True)
            u = u.withColumn("_known", F.max("_old").over(Window.partitionBy(*label_key())))
            cand = u.where(F.col("_old").isNull() & (F.col("_known").isNull() | (F.col("_rank") > F.col("_known"))))
        with small_job(spark, n_frontier):
            improved, n_frontier = write_counted(cand.select(*LABEL_COLS), "search-round")
        if made is not None:
            made.append(n_frontier)
        if n_frontier == 0:
            break
        pieces.append(improved)
        frontier = improved
        if to_target:
            # best arrival at the target so far; only target rows are aggregated
            nb = (improved.where(F.col("to_node") == F.col("target"))
                  .groupBy("query_id").agg(F.min("to_t").alias("_nb")))
            nb = F.broadcast(nb) if n_queries <= BROADCAST_QUERIES else nb
            frontier = (frontier.join(nb, "query_id", "left")
                        .withColumn("bound", F.least("bound", F.coalesce("_nb", "bound")))
                        .where(F.col("to_t") <= F.col("bound")).select(*LABEL_COLS))
    if not pieces:
        return _virtual_labels(q).limit(0), q
    of = F.struct("best", (-F.col("to_t")).alias("early"), *[c for c in LABEL_COLS if c not in ("query_id", "edge_id", "best")])
    return (_union(pieces).groupBy(*label_key()).agg(F.max(F.struct(of.alias("r"), F.col("query_id"), F.col("edge_id"))).alias("m"))
            .select("m.query_id", "m.edge_id", "m.r.*").select(*LABEL_COLS)), q


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def known_stops(rides: DataFrame, walks: DataFrame | None, side: str) -> DataFrame:
    """Stops that a ride or a walking link leaves (``dep_node``) or reaches (``arr_node``)."""
    out = rides.select(side)
    return (out if walks is None else out.unionByName(walks.select(side))).distinct()


def _validate(queries: DataFrame, rides: DataFrame, walks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Splits queries into searchable ones and rejects with a reason.
    Every input row is in exactly one of the two."""
    deps = known_stops(rides, walks, "dep_node").withColumn("_d", F.lit(True))
    arrs = known_stops(rides, walks, "arr_node").withColumn("_a", F.lit(True))
    ids = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    v = queries.join(deps, "dep_node", "left").join(arrs, "arr_node", "left").join(ids, "query_id", "left")
    reason = (F.when(F.col("query_id").isNull(), F.lit("query_id missing"))
              .when(F.col("_n") > 1, F.lit("duplicate query_id"))
              .when(~F.coalesce(F.col("mode").isin("depart", "arrive"), F.lit(False)), F.lit("unknown mode"))
              .when(F.col("t_sow").isNull(), F.lit("time missing or malformed"))
              .when(F.col("_d").isNull(), F.lit("unknown departure stop"))
              .when(F.col("_a").isNull(), F.lit("unknown arrival stop"))
              .when(~F.coalesce(F.col("threshold").between(0.0, 1.0), F.lit(False)), F.lit("threshold outside [0, 1]")))
    v = v.withColumn("reason", reason).drop("_d", "_a", "_n")
    return v.where(F.col("reason").isNull()).drop("reason"), v.where(F.col("reason").isNotNull())


def _real_times(mode: str, t: F.Column, dep_sow: F.Column, arr_sow: F.Column):
    dur = arr_sow - dep_sow
    if mode == "depart":
        dep = t + F.pmod(dep_sow - t, F.lit(WEEK_S))
        return dep, dep + dur
    arr = t - F.pmod(t - arr_sow, F.lit(WEEK_S))
    return arr - dur, arr


# The per-query bound table has one row per query; broadcast it up to this many.
BROADCAST_QUERIES = 2_000_000
# Places to board (label, stop, hour bin) of a round, rows of some 200 bytes; broadcast up to this many.
BROADCAST_PLACES = 100_000

ITINERARY_SCHEMA = ("query_id long, leg int, kind string, trip_id long, dep_node string, arr_node string, "
                    "dep_sow int, arr_sow int, prob double, board_edge long, alight_edge long")

# Time bounds of the successive search passes (seconds after/before the query).
DEEPENING_S = (4 * 3600, DAY_S)
# Rides from one stop that a query can finish, on average, in the shorter passes before these.
FIRST_RIDES = 8


def _answers(labels: DataFrame, qf: DataFrame, sw: DataFrame) -> DataFrame:
    """Best way to reach the target per query (A16, W6): earliest arrival,
    then higher probability, then later start, then fewer rides, then a
    stable path key."""
    arr = _target_arrivals(labels, qf, sw)
    order = F.struct(F.col("arr_t"), -F.col("best.prob"), -F.col("best.start_t"), -F.col("best.nrn"),
                     F.col("best.pkey"))
    best = (arr.groupBy("query_id")
            .agg(F.min_by(F.struct("arr_t", "best", "edge_id", "virtual", "trail"), order).alias("r"))
            .select("query_id", "r.*"))
    return best.join(qf.select("query_id", "T"), "query_id")


def _walk_legs(trail: F.Column) -> F.Column:
    return F.transform(trail, lambda x: walk_leg(x["a"], x["b"], x["walk_s"]))


def _with_legs(best: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, T, best.prob, legs): ``legs`` is the path in search order, found by following the
    pointers back from the answers (J14): a join per ride of the longest answer. Written once, so
    that no reader follows them again and nothing of it stays on the executors."""
    ridden = (labels.where(F.col("links") == 0)
              .select("query_id", F.col("edge_id").alias("_edge"), F.col("best.board").alias("_board"),
                      F.col("best.before").alias("_before"), F.col("best.via").alias("_via")))
    # only the labels of answered queries can be on a path; one is looked up per query and ride
    found = best.agg(F.max(-F.col("best.nrn")).alias("rides"), F.count(F.lit(1)).alias("n")).first()
    rides, answered = found["rides"] or 0, best.select("query_id")
    answered = F.broadcast(answered) if found["n"] <= BROADCAST_QUERIES else answered
    ridden = ridden.join(answered, "query_id", "left_semi").withColumnRenamed("query_id", "_query")
    x = best.select("query_id", "T", F.struct("best.prob").alias("best"), _walk_legs(F.col("trail")).alias("legs"),
                    F.when(~F.col("virtual"), F.col("edge_id")).alias("_at"))
    if rides:
        # the pointers are dealt once: a step moves the answers alone
        with shuffles_removed(best.sparkSession):
            ridden = dealt(ridden, "_query", "_edge")
    for _ in range(rides):
        ride = F.array(ride_leg(F.col("_board"), F.col("_at")))
        x = (x.join(ridden, (F.col("query_id") == F.col("_query")) & (F.col("_at") == F.col("_edge")), "left")
             .withColumns({"legs": F.when(F.col("_edge").isNull(), F.col("legs"))
                           .otherwise(F.concat(_walk_legs(F.col("_via")), ride, F.col("legs"))), "_at": F.col("_before")})
             .drop("_query", "_edge", "_board", "_before", "_via"))
    out, _ = write_counted(x.drop("_at"), "search-paths")
    ridden.unpersist()
    return out


def plan(queries: DataFrame, tt: Timetable, params: SearchParams = SearchParams(),
         deepening: tuple[int, ...] = DEEPENING_S, with_itinerary: bool = True) -> tuple[DataFrame, DataFrame]:
    """Depart-at (G1) and arrive-by (G2) plans for a table of queries.

    queries(query_id, mode, dep_node, arr_node, t_sow, threshold).
    Returns (summary, itinerary):
      summary(query_id, mode, status, dep_sow, arr_sow, prob, n_rides)
      itinerary(query_id, leg, kind, trip_id, dep_node, arr_node, dep_sow, arr_sow, prob);
      empty without ``with_itinerary``, which saves the walk back from the answers
    Times are seconds of week in the query's frame (may pass the week's end
    or be negative around Monday 00:00).

    The search runs in passes with growing time bounds: short ones that the
    timetable's density allows, then ``deepening``. An answer that arrives within a pass's bound is final: every label on an
    optimal path arrives no later than the answer, and labels within the
    bound are computed exactly. An answer past the bound (its last stretch is
    a walk) is not: it goes to the next pass with the unanswered queries.
    """
    ok, rejected = _validate(queries, tt.rides, tt.walks)
    ok, _ = write_counted(ok, "search-valid")
    deepening = (*tt.short_bounds(deepening[0], FIRST_RIDES), *deepening)
    summaries, itins = [], []
    for mode in ("depart", "arrive"):
        qm = ok.where(F.col("mode") == mode)
        start, target = ("dep_node", "arr_node") if mode == "depart" else ("arr_node", "dep_node")
        trivial = qm.where(F.col("dep_node") == F.col("arr_node"))
        pending, n_pending = write_counted(qm.where(F.col("dep_node") != F.col("arr_node")).select(
            "query_id", F.col("t_sow").cast("int").alias("T"), F.col(start).alias("start"),
            F.col(target).alias("target"), F.col("threshold").cast("double")), "search-pending")
        sw = tt.prepared(mode, params).links
        found, paths = [], []
        summaries.append(trivial.select("query_id", F.lit(mode).alias("mode"), F.lit("trivial").alias("status"),
                                        F.col("t_sow").cast("int").alias("dep_sow"),
                                        F.col("t_sow").cast("int").alias("arr_sow"),
                                        F.lit(1.0).alias("prob"), F.lit(0).alias("n_rides")))
        if n_pending == 0:
            continue
        for level, bound in enumerate(deepening):
            qs = pending.withColumn("bound", F.lit(int(bound)))
            labels, qf = search(qs, tt, mode, params, to_target=True)
            answers = _answers(labels, qf, sw)
            if level < len(deepening) - 1:
                answers = answers.where(F.col("arr_t") <= bound)
            best, n_found = write_counted(answers, "search-answers")
            found.append(best)
            if n_found and with_itinerary:
                paths.append(_with_legs(best, labels))
            n_pending -= n_found
            if n_pending == 0:
                break
            pending = pending.join(best.select("query_id"), "query_id", "left_anti")
        if paths:
            itins.append(_itinerary(_union(paths), tt.rides, mode))
        # in search direction a path starts start_t and ends arr_t after the query (before it, in arrive mode)
        begin, end = F.col("T") + F.col("best.start_t"), F.col("T") + F.col("arr_t")
        if mode == "arrive":
            begin, end = F.col("T") - F.col("arr_t"), F.col("T") - F.col("best.start_t")
        agg = _union(found).select("query_id", begin.alias("dep_sow"), end.alias("arr_sow"), F.col("best.prob").alias("prob"),
                                   (-F.col("best.nrn")).alias("n_rides"))
        searched = qm.where(F.col("dep_node") != F.col("arr_node")).select("query_id")
        found_df = searched.join(agg, "query_id", "left")
        st = F.when(F.col("prob").isNotNull(), F.lit("ok")).otherwise(F.lit("no_path"))
        summaries.append(found_df.select("query_id", F.lit(mode).alias("mode"), st.alias("status"),
                                         F.col("dep_sow").cast("int"), F.col("arr_sow").cast("int"),
                                         "prob", F.col("n_rides").cast("int")))
    summaries.append(rejected.select("query_id", "mode", F.concat(F.lit("rejected: "), F.col("reason")).alias("status"),
                                     F.lit(None).cast("int").alias("dep_sow"), F.lit(None).cast("int").alias("arr_sow"),
                                     F.lit(None).cast("double").alias("prob"), F.lit(None).cast("int").alias("n_rides")))
    summary = summaries[0]
    for s_ in summaries[1:]:
        summary = summary.unionByName(s_)
    if itins:
        itinerary = itins[0]
        for it in itins[1:]:
            itinerary = itinerary.unionByName(it)
        itinerary, _ = write_counted(itinerary, "search-itinerary")
    else:
        itinerary = queries.sparkSession.createDataFrame([], ITINERARY_SCHEMA)
    return summary, itinerary


def _itinerary(best: DataFrame, rides: DataFrame, mode: str) -> DataFrame:
    """Path array → one row per leg in real-time order, with times (J14, G7,
    G8, W7). Walks start when the previous leg ends."""
    legs = F.col("legs")
    if mode == "arrive":
        legs = F.transform(F.reverse(legs), lambda l: F.struct(
            l["kind"].alias("kind"), l["e2"].alias("e1"), l["e1"].alias("e2"),
            l["wb"].alias("wa"), l["wa"].alias("wb"), l["walk_s"].alias("walk_s")))
    x = best.select("query_id", "T", F.col("best.prob").alias("prob"),
                    F.posexplode(legs).alias("pos", "l"))
    b = rides.select(F.col("edge_id").alias("_e1"), F.col("trip_id").alias("trip_id"),
                     F.col("dep_node").alias("_dn"), F.col("dep_sow").alias("_b_dep"),
                     F.col("arr_sow").alias("_b_arr"))
    a = rides.select(F.col("edge_id").alias("_e2"), F.col("arr_node").alias("_an"),
                     F.col("dep_sow").alias("_a_dep"), F.col("arr_sow").alias("_a_arr"))
    x = (x.join(b, F.col("l.e1") == F.col("_e1"), "left").join(a, F.col("l.e2") == F.col("_e2"), "left"))
    t = F.col("T")
    bdep, _ = _real_times(mode, t, F.col("_b_dep"), F.col("_b_arr"))
    _, aarr = _real_times(mode, t, F.col("_a_dep"), F.col("_a_arr"))
    if mode == "arrive":
        # the real boarding edge is reached later in time than the search frame
        # assumes only when it is the same vehicle; its time follows the alight edge
        bdep = aarr - (F.col("_a_arr") - F.col("_b_dep"))
    else:
        aarr = bdep + (F.col("_a_arr") - F.col("_b_dep"))
    x = x.withColumns({"r_dep": bdep, "r_arr": aarr})
    # a walking link starts when the ride before it and the links since have ended; leading links
    # start at the query (depart), or so that they end when the first ride leaves (arrive)
    w = Window.partitionBy("query_id").orderBy("pos")
    is_walk = F.col("l.kind") == "walk"
    x = x.withColumns({"_ride_no": F.sum((~is_walk).cast("int")).over(w),
                       "_prev": F.max("r_arr").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                       "_next": F.min("r_dep").over(w.rowsBetween(1, Window.unboundedFollowing))})
    stretch = Window.partitionBy("query_id", "_ride_no").orderBy("pos")
    walked = F.coalesce(F.sum("l.walk_s").over(stretch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    to_walk = F.coalesce(F.sum("l.walk_s").over(stretch.rowsBetween(0, Window.unboundedFollowing)), F.lit(0))
    x = x.withColumns({"_walked": walked, "_to_walk": to_walk})
    first_dep = t + F.col("_walked") if mode == "depart" else F.coalesce("_next", t) - F.col("_to_walk")
    walk_dep = F.coalesce(F.col("_prev") + F.col("_walked"), first_dep)
    x = x.withColumns({
        "dep_sow": F.when(is_walk, walk_dep).otherwise(F.col("r_dep")),
        "arr_sow": F.when(is_walk, walk_dep + F.col("l.walk_s")).otherwise(F.col("r_arr"))})
    return x.select("query_id", (F.col("pos") + 1).alias("leg"), F.col("l.kind").alias("kind"),
                    F.when(~is_walk, F.col("trip_id")).alias("trip_id"),
                    F.when(is_walk, F.col("l.wa")).otherwise(F.col("_dn")).alias("dep_node"),
                    F.when(is_walk, F.col("l.wb")).otherwise(F.col("_an")).alias("arr_node"),
                    F.col("dep_sow").cast("int"), F.col("arr_sow").cast("int"), "prob",
                    F.col("l.e1").alias("board_edge"), F.col("l.e2").alias("alight_edge"))


def itinerary_edges(itin: DataFrame, rides: DataFrame) -> DataFrame:
    """One row per edge of the path (G8): a ride leg becomes the edges of its
    run between boarding and alighting, a walk stays one row.
    (query_id, step, leg, kind, trip_id, dep_node, arr_node, dep_sow, arr_sow, prob)"""
    at = rides.select("edge_id", "trip_id", "day_start", "seg", "seq", "dep_sow")
    first = at.select(F.col("edge_id").alias("board_edge"), F.col("day_start").alias("_day"), F.col("seg").alias("_seg"),
                      F.col("seq").alias("_from"), F.col("dep_sow").alias("_b_dep"))
    last = at.select(F.col("edge_id").alias("alight_edge"), F.col("seq").alias("_to"))
    run = rides.select(F.col("trip_id").alias("_trip"), "day_start", "seg", "seq", F.col("dep_node").alias("_dn"),
                       F.col("arr_node").alias("_an"), F.col("dep_sow").alias("_dep"), F.col("arr_sow").alias("_arr"))
    legs = itin.where("kind = 'ride'").join(first, "board_edge").join(last, "alight_edge")
    ridden = legs.join(run, (F.col("trip_id") == F.col("_trip")) & (F.col("_day") == F.col("day_start"))
                       & (F.col("_seg") == F.col("seg")) & F.col("seq").between(F.col("_from"), F.col("_to")))
    ridden = ridden.select("query_id", "leg", "kind", "trip_id", F.col("_dn").alias("dep_node"), F.col("_an").alias("arr_node"),
                           (F.col("dep_sow") + F.col("_dep") - F.col("_b_dep")).cast("int").alias("dep_sow"),
                           (F.col("dep_sow") + F.col("_arr") - F.col("_b_dep")).cast("int").alias("arr_sow"), "prob", "seq")
    walked = itin.where("kind = 'walk'").select(
        "query_id", "leg", "kind", "trip_id", "dep_node", "arr_node", "dep_sow", "arr_sow", "prob", F.lit(0).alias("seq"))
    step = F.row_number().over(Window.partitionBy("query_id").orderBy("leg", "seq"))
    return ridden.unionByName(walked).withColumn("step", step).select(
        "query_id", "step", "leg", "kind", "trip_id", "dep_node", "arr_node", "dep_sow", "arr_sow", "prob")


def itinerary_stops(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Stop-wise table (W7, J9): every stop of the path with its arrival and
    departure, the first without arrival and the last without departure, and
    coordinates. (query_id, pos, stop, arr_sow, dep_sow, arr_clock, dep_clock, lon, lat)"""
    edges, _ = write_counted(edges, "itinerary-edges")  # read twice
    w = Window.partitionBy("query_id").orderBy("step")
    left = edges.select("query_id", F.col("step").alias("pos"), F.col("dep_node").alias("stop"),
                        F.lag("arr_sow").over(w).alias("arr_sow"), "dep_sow")
    ends = (edges.groupBy("query_id").agg(F.max(F.struct("step", "arr_node", "arr_sow")).alias("e"))
            .select("query_id", (F.col("e.step") + 1).alias("pos"), F.col("e.arr_node").alias("stop"),
                    F.col("e.arr_sow").alias("arr_sow"), F.lit(None).cast("int").alias("dep_sow")))
    return (left.unionByName(ends).join(stops.select("stop", "lon", "lat"), "stop", "left")
            .withColumns({"arr_clock": format_hms("arr_sow"), "dep_clock": format_hms("dep_sow")})
            .select("query_id", "pos", "stop", "arr_sow", "dep_sow", "arr_clock", "dep_clock", "lon", "lat"))


def clock_queries(q: DataFrame) -> DataFrame:
    """Queries with a clock time 'HH:MM:SS' and an optional weekday (Monday = 0,
    null: today) get ``t_sow`` (F19, F20); a malformed time gives null, which
    the search rejects."""
    day = F.coalesce(F.col("day"), today_weekday())
    return (q.withColumn("t_sow", F.when(is_hms("clock") & day.between(0, 6), sow(day, hhmm_to_sod("clock"))).cast("int"))
            .drop("clock", "day"))


def itinerary_display(itin: DataFrame, stops: DataFrame) -> DataFrame:
    """Itinerary with coordinates and clock times."""
    return (itin.join(stops.select(F.col("stop").alias("dep_node"), F.col("lon"), F.col("lat")), "dep_node", "left")
            .withColumns({"dep_day": F.floor(F.pmod("dep_sow", F.lit(WEEK_S)) / DAY_S),
                          "dep_clock": format_hms("dep_sow"), "arr_clock": format_hms("arr_sow")}))


def direction_flags(df: DataFrame, stops: DataFrame, from_col: str, to_col: str, target_col: str) -> DataFrame:
    """``nice`` = the edge ends closer to the target than it starts.
    Coordinates come through equi-joins on the stop name."""
    from transitrisk.functions.geo import haversine_m
    # the edges are not shuffled for a small table of stops
    stops = F.broadcast(stops) if stops.count() <= BROADCAST_PLACES else stops
    c = lambda p: stops.select(F.col("stop").alias(f"{p}_stop"), F.col("lat").alias(f"{p}_lat"),
                               F.col("lon").alias(f"{p}_lon"))
    j = (df.join(c("a"), F.col(from_col) == F.col("a_stop"))
         .join(c("b"), F.col(to_col) == F.col("b_stop"))
         .join(c("t"), F.col(target_col) == F.col("t_stop")))
    nice = haversine_m("b_lat", "b_lon", "t_lat", "t_lon") < haversine_m("a_lat", "a_lon", "t_lat", "t_lon")
    return j.withColumn("nice", nice).drop(*[f"{p}_{k}" for p in "abt" for k in ("stop", "lat", "lon")])
