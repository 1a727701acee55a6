"""The whole flow in one call: observations and stops → weekly timetable →
support → delay percentiles → KMeans → one gamma law per cluster → search
timetable (A2-A10, M1, M3, J7, J8, P9, S4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitrisk.operators import clustering, delays
from transitrisk.operators import timetable as weekly
from transitrisk.plans.journeys import Timetable, build_timetable, prepare_rides
from transitrisk.session import cut_lineage


def fitted_laws(fits: DataFrame, key: str = "cluster") -> DataFrame:
    """Fits per cluster → delay laws (dist_id, shape, loc, scale); a point mass has a null shape."""
    point = (F.col("method") == "point") | F.col("shape").isNull() | F.isnan("shape")
    return fits.select(F.col(key).cast("string").alias("dist_id"),
                       *[F.when(~point, F.col(c)).alias(c) if c != "loc" else F.col(c) for c in ("shape", "loc", "scale")])


def build_timetable_from_obs(spark, obs: DataFrame, stops: DataFrame, k: int = clustering.K_CHOSEN,
                             min_support: int = 20, bad_stop: str | None = None, seed: int = 0,
                             loc_pad: float = delays.DEFAULT_LOC_PAD) -> tuple[Timetable, DataFrame]:
    """(timetable, laws) from observations (``OBS_COLUMNS``) and stops (stop, lon, lat).
    ``bad_stop`` is bridged over in anomalous runs (W3)."""
    pairs = weekly.consecutive_pairs(weekly.delay_stats(obs))
    if bad_stop is not None:
        pairs = weekly.bridge_repair(pairs, bad_stop)
    edges = cut_lineage(weekly.finalize_edges(weekly.support_filter(weekly.valid_edges(pairs), min_support)))
    long = delays.edge_delays(edges, obs)
    feats = clustering.features(delays.delay_percentiles(long, "edge_id"))
    labels = cut_lineage(clustering.cluster_labels(feats, k, seed).select("edge_id", "cluster"))
    fits = delays.fit_gamma(delays.gamma_stats(long.join(labels, "edge_id").select("cluster", "delay"), "cluster", loc_pad=loc_pad))
    laws = cut_lineage(fitted_laws(fits))
    rides = prepare_rides(edges.join(labels, "edge_id"), dist_col="cluster")
    return build_timetable(spark, rides, stops, laws), laws
