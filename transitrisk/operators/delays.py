"""Delay models: percentiles, histograms, gamma fits, CDF grids
(A5, A8-A12, F11-F14, J7, M4)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitrisk.functions import gamma as G

# The percentile features of an edge's delays.
PERCENTILES = [20, 30, 40, 50, 60, 70, 80]
FEATURE_COLS = [f"p{p}" for p in PERCENTILES]
DEFAULT_LOC_PAD = 1e-10
HIST_BINS = 100
PDF_POINTS = 1000
GRID_BROADCAST_CELLS = 2_000_000  # grid points broadcast as (law, second, p) rows


def edge_delays(edges: DataFrame, obs: DataFrame) -> DataFrame:
    """Long form (edge_id, delay): each edge gets the arrival delays of its
    arrival stop row. Join on the arrival-row key; AQE splits hot keys."""
    key = edges.select("edge_id", F.col("trip_id"), F.col("day_start"),
                       F.col("arr_day").alias("week_day"), F.col("arr_sod"),
                       F.col("arr_row_dep_sod").alias("dep_sod"), F.col("arr_node").alias("stop"))
    return (obs.where(F.col("arrival_delay").isNotNull())
            .join(key, on=["trip_id", "day_start", "week_day", "arr_sod", "dep_sod", "stop"])
            .select("edge_id", F.col("arrival_delay").alias("delay")))


def delay_counts(long: DataFrame, key: str, value: str = "delay") -> DataFrame:
    """(key, value, cnt): how often each measured delay occurs. Delays are whole
    seconds within ±1000, so a key has at most 1999 rows however often it is observed."""
    return (long.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("value"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def delay_percentiles(long: DataFrame, key: str | list[str], value: str = "delay",
                      approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Seven percentiles (20…80) per key with linear interpolation.

    Exact ``percentile`` keeps a value→count map per group, so integer
    delays in ±1000 s stay bounded however large a group is;
    ``approx=True`` switches to the mergeable sketch.
    """
    keys = [key] if isinstance(key, str) else list(key)
    probs = F.array(*[F.lit(p / 100.0) for p in PERCENTILES])
    x = F.col(value).cast("double")
    agg = (F.percentile_approx(x, probs, accuracy) if approx else F.percentile(x, probs)).alias("_q")
    return (long.groupBy(*keys).agg(agg, F.count(x).alias("n"))
            .select(*keys, "n", *[F.col("_q")[i].alias(c) for i, c in enumerate(FEATURE_COLS)]))


def delay_histogram(long: DataFrame, key: str, value: str = "delay", bins: int = HIST_BINS) -> DataFrame:
    """Normalised ``bins``-bin histogram per key between its min and max (A12), from
    the counts per (key, delay): the observations are scanned once."""
    per = Window.partitionBy(key)
    counts = delay_counts(long, key, value).withColumns({
        "lo": F.min("value").over(per), "hi": F.max("value").over(per), "n": F.sum("cnt").over(per)})
    x = F.col("value").cast("double")
    width = (F.col("hi") - F.col("lo")).cast("double")
    b = F.when(width > 0, F.least(F.floor((x - F.col("lo")) / width * bins) + 1, F.lit(bins))) \
        .otherwise(F.lit(1))
    h = (counts.withColumn("bin", b.cast("int"))
         .groupBy(key, "bin", "lo", "hi", "n").agg(F.sum("cnt").alias("cnt")))
    bw = F.when(width > 0, width / bins).otherwise(F.lit(1.0))
    return h.select(key, "bin", "cnt", (F.col("cnt") / (F.col("n") * bw)).alias("density"))


def gamma_stats(long: DataFrame, key: str, value: str = "delay",
                loc_pad: float = DEFAULT_LOC_PAD) -> DataFrame:
    """Sufficient statistics of a location-fixed gamma fit per key (A9, A10):
    n, min, loc = min − pad, mean and mean log of x − loc, sample variance.
    One scan: everything follows from the counts per (key, delay)."""
    return stats_from_counts(delay_counts(long, key, value), key, F.lit(float(loc_pad)))


def stats_from_counts(counts: DataFrame, key: str, pad: Column) -> DataFrame:
    """``gamma_stats`` from (key, value, cnt); ``pad`` is constant within a key."""
    h = (counts.withColumn("_pad", pad).groupBy(key)
         .agg(F.min("value").alias("x_min"), F.sum("cnt").alias("n"), F.max("_pad").alias("_pad"),
              F.array_sort(F.collect_list(F.struct(F.col("value").cast("double").alias("x"), "cnt"))).alias("h"))
         .withColumn("loc", F.col("x_min").cast("double") - F.col("_pad")).drop("_pad"))

    def mean(of):
        return F.aggregate("h", F.lit(0.0), lambda s, r: s + r["cnt"] * of(r["x"])) / F.col("n")

    h = h.withColumns({"mean_shift": mean(lambda x: x - F.col("loc")), "mean_log": mean(lambda x: F.ln(x - F.col("loc")))})
    var = mean(lambda x: F.pow(x - F.col("loc") - F.col("mean_shift"), F.lit(2))) * F.col("n") / (F.col("n") - 1)
    return h.withColumn("var", F.when(F.col("n") > 1, var)).drop("h")


FIT_SCHEMA = T.StructType([
    T.StructField("method", T.StringType()), T.StructField("shape", T.DoubleType()),
    T.StructField("loc", T.DoubleType()), T.StructField("scale", T.DoubleType()),
    T.StructField("lgamma_shape", T.DoubleType())])


def _fit_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    n = pdf["n"].to_numpy(dtype=float)
    m = pdf["mean_shift"].to_numpy(dtype=float)
    ml = pdf["mean_log"].to_numpy(dtype=float)
    var = pdf["var"].to_numpy(dtype=float)
    loc = pdf["loc"].to_numpy(dtype=float)
    s = np.log(m) - ml
    ok = (n >= 2) & np.isfinite(s) & (s > 1e-12)
    shape = np.full(len(pdf), np.nan)
    if ok.any():
        shape[ok] = G.solve_shape(s[ok])
    scale = np.where(ok, m / shape, np.nan)
    method = np.where(ok, "mle", "point")
    # moments fallback (free location) when the location-fixed MLE is degenerate
    mom = (~ok) & (n >= 2) & np.nan_to_num(var > 0)
    if mom.any():
        mu = loc[mom] + m[mom]
        k = (m[mom] ** 2) / var[mom]
        shape[mom] = k
        scale[mom] = var[mom] / m[mom]
        loc = loc.copy()
        loc[mom] = mu - k * scale[mom]
        method = method.astype(object)
        method[mom] = "moments"
    point_loc = np.where(method == "point", loc + np.nan_to_num(m), loc)
    out = pdf.drop(columns=[c for c in ("loc",) if c in pdf.columns]).copy()
    out["method"] = method
    out["shape"] = shape
    out["loc"] = point_loc
    out["scale"] = scale
    out["lgamma_shape"] = [math.lgamma(a) if np.isfinite(a) and a > 0 else np.nan for a in shape]
    return out


def fit_gamma(stats: DataFrame) -> DataFrame:
    """Shape/scale from the sufficient statistics (one row per key; Newton on
    ln a − ψ(a) = ln mean − mean ln). Degenerate keys fall back to a moments
    fit, or a point mass when there is no spread."""
    in_cols = [f for f in stats.schema.fields if f.name != "loc"]
    schema = T.StructType(in_cols + list(FIT_SCHEMA.fields))
    return stats.mapInPandas(lambda it: (_fit_rows(p) for p in it), schema)


@F.pandas_udf(T.DoubleType())
def gamma_cdf_udf(x: pd.Series, shape: pd.Series, loc: pd.Series, scale: pd.Series) -> pd.Series:
    """Vectorised gamma CDF (F12); a null shape means a point mass at ``loc``."""
    out = np.zeros(len(x))
    xs = x.to_numpy(dtype=float)
    keys = pd.DataFrame({"a": shape, "l": loc, "s": scale}).fillna(-1.0)
    for (a, l, s), idx in keys.groupby(["a", "l", "s"]).indices.items():
        if a <= 0 or s <= 0:
            out[idx] = (xs[idx] >= l).astype(float)
        else:
            out[idx] = G.gamma_cdf(xs[idx], a, l, s)
    return pd.Series(out)


def gamma_pdf_curve(fits: DataFrame, key: str, points: int = PDF_POINTS) -> DataFrame:
    """Gamma density on ``points`` equally spaced delays between each key's
    min and max observed delay (F13), evaluated in closed form on the JVM."""
    g = fits.where(F.col("method") != "point").withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    hi = F.col("x_max") if "x_max" in fits.columns else F.col("x_min") + F.col("scale") * F.col("shape") * 4
    x = F.col("x_min") + (hi - F.col("x_min")) * F.col("i") / F.lit(points - 1)
    z = (x - F.col("loc")) / F.col("scale")
    pdf = F.when(z > 0, F.exp((F.col("shape") - 1) * F.ln(z) - z - F.col("lgamma_shape")) / F.col("scale")) \
        .otherwise(F.lit(0.0))
    return g.select(key, "i", x.alias("x"), pdf.alias("pdf"))


def cdf_at(fits: DataFrame, key: str, at_s: float) -> DataFrame:
    """Probability that the delay is at most ``at_s`` seconds per key (M4)."""
    shape = F.when(F.col("method") == "point", F.lit(None).cast("double")).otherwise(F.col("shape"))
    return fits.select(key, gamma_cdf_udf(F.lit(float(at_s)), shape, F.col("loc"), F.col("scale"))
                       .alias("cdf"))


#: Wider than any slack: numbers of (law, second).
LAW_SPAN = 1 << 32
GRID_SCHEMA = "dist_id string, lo int, grid array<double>"


def cdf_grids(dists: DataFrame, max_slack: int = 86400) -> DataFrame:
    """Per distribution: CDF at every integer second from ``lo`` until it is
    exactly 1 (F12). Input: dist_id, shape, loc, scale (null shape = point mass)."""
    def build(it):
        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                shape = None if r.shape is None or pd.isna(r.shape) else float(r.shape)
                scale = None if r.scale is None or pd.isna(r.scale) else float(r.scale)
                lo, grid = G.cdf_grid(shape, float(r.loc), scale, max_slack)
                rows.append((str(r.dist_id), lo, grid))
            yield pd.DataFrame(rows, columns=["dist_id", "lo", "grid"])
    return (dists.select(F.col("dist_id").cast("string"), F.col("shape").cast("double"),
                         F.col("loc").cast("double"), F.col("scale").cast("double"))
            .mapInPandas(build, GRID_SCHEMA))


def grid_cells(grids: DataFrame) -> int:
    """Total number of grid cells (one aggregate over the per-law table)."""
    return int(grids.select(F.sum(F.size("grid"))).first()[0] or 0)


def cdf_tables(grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bounds, points): one row per law with its grid range, and one row per
    (law, second) with the CDF value."""
    bounds = grids.select(F.col("dist_id").alias("_did"), F.col("lo").alias("_lo"),
                          (F.col("lo") + F.size("grid") - 1).alias("_hi"))
    pts = (grids.select(F.col("dist_id").alias("_did"), "lo", F.posexplode("grid").alias("_k", "_p"))
           .select("_did", (F.col("lo") + F.col("_k")).alias("_s"), "_p"))
    return bounds, pts


def with_cdf(df: DataFrame, grids: DataFrame, dist_col: str, slack_col: str, out_col: str = "p",
             cells: int | None = None, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Adds ``out_col`` = CDF of ``dist_col``'s law at integer ``slack_col``.

    Equi-join on (law, slack clamped to the law's grid) against one row per
    grid point. The point table is broadcast only when its size (checked
    with one aggregate) is below a fixed bound; beyond it the join shuffles.
    The per-law bounds table has fewer rows than the grids have points and
    follows the same check. Beyond its grid a law keeps its last value.
    Rows with a null law get probability 1.
    """
    if cells is None:
        cells = grid_cells(grids)
    bounds, pts = tables or cdf_tables(grids)
    if cells <= GRID_BROADCAST_CELLS:
        bounds, pts = F.broadcast(bounds), F.broadcast(pts)
    d = df.withColumn("_did", F.col(dist_col).cast("string"))
    j = (d.join(bounds, on="_did", how="left")
         .withColumn("_s", F.greatest(F.least(F.col(slack_col), F.col("_hi")), F.col("_lo")))
         .join(pts, on=["_did", "_s"], how="left"))
    p = (F.when(F.col("_did").isNull(), F.lit(1.0))
         .when(F.col(slack_col) < F.col("_lo"), F.lit(0.0))
         .otherwise(F.col("_p")))
    return j.withColumn(out_col, p).drop("_did", "_lo", "_hi", "_s", "_p")


def cdf_laws(grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(laws, points) for looking a CDF up by number: one row per law (``_did``, its number, grid range
    and last value), and one per (law, second) under a single integer key. Laws are few (K rows)."""
    numbers = (grids.select("dist_id").distinct().withColumn("_law", F.row_number().over(Window.orderBy("dist_id")).cast("long"))
               .withColumnRenamed("dist_id", "_did"))
    g = grids.join(F.broadcast(numbers), F.col("dist_id") == F.col("_did"))
    laws = g.select("_did", "_law", F.col("lo").alias("_lo"), (F.col("lo") + F.size("grid") - 1).alias("_hi"), F.element_at("grid", -1).alias("_last"))
    points = (g.select("_law", "lo", F.posexplode("grid").alias("_k", "_p"))
              .select((F.col("_law") * LAW_SPAN + F.col("lo") + F.col("_k")).alias("_at"), "_p"))
    return laws, points


def with_law(df: DataFrame, laws: DataFrame, dist_col: str) -> DataFrame:
    """Adds the columns of ``dist_col``'s law; without a law every slack has probability 1."""
    j = df.join(F.broadcast(laws), F.col(dist_col).cast("string") == F.col("_did"), "left").drop("_did")
    free, least = F.col(dist_col).isNull(), F.lit(-2**30)
    return j.withColumns({"_lo": F.when(free, least).otherwise(F.col("_lo")), "_hi": F.when(free, least).otherwise(F.col("_hi")),
                          "_last": F.when(free, F.lit(1.0)).otherwise(F.col("_last"))})


def cdf_of(df: DataFrame, points: DataFrame, cells: int, slack_col: str, out_col: str = "p") -> DataFrame:
    """Like ``with_cdf`` for rows that carry their law's columns (``with_law``): only slacks inside the grid are looked up, and by one number."""
    slack = F.col(slack_col)
    inside = slack.between(F.col("_lo"), F.col("_hi") - 1)
    points = F.broadcast(points) if cells <= GRID_BROADCAST_CELLS else points
    j = df.withColumn("_key", F.when(inside, F.col("_law") * LAW_SPAN + slack)).join(points, F.col("_key") == F.col("_at"), "left")
    p = F.when(slack < F.col("_lo"), F.lit(0.0)).when(inside, F.col("_p")).otherwise(F.col("_last"))
    return j.withColumn(out_col, p).drop("_key", "_at", "_p", "_law", "_lo", "_hi", "_last")


def attach_distribution(edges: DataFrame, clusters: DataFrame, key: str = "cluster") -> DataFrame:
    """Cluster label → distribution parameters (J7); the cluster table has one
    row per cluster (K rows), so it is broadcast."""
    return edges.join(F.broadcast(clusters.select(key, "method", "shape", "loc", "scale")),
                      on=key, how="left")
