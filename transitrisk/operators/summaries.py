"""Mergeable delay summaries, exact quantiles of a whole table and the choice of a
delay law by fit (A2, A5, A8, A9, A11, A12).

A summary is a table (period, key, value, cnt) partitioned by period: how often a
key showed each whole-second delay in, say, a month. Counts add up, so a new
period is summarised alone and merged with the stored ones; moments,
percentiles, histograms and fits all follow from the merged counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitrisk.operators.delays import (DEFAULT_LOC_PAD, FEATURE_COLS, PERCENTILES, fit_gamma, gamma_cdf_udf,
                                          stats_from_counts)
from transitrisk.session import scratch_path, write_counted

#: Locations tried below a key's least delay, as shares of its spread, beside the fixed pad.
PROFILE_SHARES = tuple(2.0 ** k for k in range(-9, 2))


def period_counts(long: DataFrame, key: str, period: str, value: str = "delay") -> DataFrame:
    """(period, key, value, cnt) of the measured delays; partial counts are made
    before the shuffle, so a key observed very often is not a hot one."""
    return (long.where(F.col(value).isNotNull())
            .groupBy(F.col(period).alias("period"), F.col(key), F.col(value).alias("value"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def write_periods(counts: DataFrame, path: str) -> None:
    """Stores the periods present in ``counts``. Each replaces what is stored of it,
    other periods stay untouched, so a repeated load changes nothing."""
    (counts.repartition("period", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("period").parquet(path))


def merged_counts(spark: SparkSession, path: str, key: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """(key, value, cnt) over the stored periods from ``first`` to ``last``; other
    periods' folders are not read."""
    stored = spark.read.parquet(path)
    if first is not None:
        stored = stored.where(F.col("period") >= F.lit(first))
    if last is not None:
        stored = stored.where(F.col("period") <= F.lit(last))
    return stored.groupBy(key, "value").agg(F.sum("cnt").alias("cnt"))


def summary_stats(counts: DataFrame, key: str) -> DataFrame:
    """(key, n, mean, std, p20 … p80): the figures of A2 and A8 from counts."""
    x = F.col("value").cast("double")
    total = F.sum("cnt")
    probs = F.array(*[F.lit(p / 100.0) for p in PERCENTILES])
    per = Window.partitionBy(key)
    mean = F.sum(x * F.col("cnt")).over(per) / F.sum("cnt").over(per)
    return (counts.withColumn("_mean", mean).groupBy(key)
            .agg(total.alias("n"), F.first("_mean").alias("mean"),
                 F.sum(F.col("cnt") * (x - F.col("_mean")) * (x - F.col("_mean"))).alias("_dev"),
                 F.percentile(x, probs, F.col("cnt")).alias("_q"))
            .select(key, "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("_dev") / (F.col("n") - 1))).alias("std"),
                    *[F.col("_q")[i].alias(c) for i, c in enumerate(FEATURE_COLS)]))


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """(prob, quantile) of a whole column with linear interpolation (A5): value
    counts, ranges of values, a running total per range on top of the ranges before.

    No task holds more than its range of distinct values, and only one row per
    range is summed up in one place. Nulls do not count; without values the
    quantiles are null."""
    spark = df.sparkSession
    path = scratch_path(spark, "quantile-counts")
    (df.select(F.col(col).cast("double").alias("value")).where(F.col("value").isNotNull())
     .groupBy("value").agg(F.count(F.lit(1)).alias("cnt")).repartitionByRange("value")
     .withColumn("part", F.spark_partition_id()).write.parquet(path))
    counts = spark.read.schema("value double, cnt long, part int").parquet(path)
    parts = (counts.groupBy("part").agg(F.sum("cnt").alias("held"))
             .withColumn("before", F.coalesce(F.sum("held").over(
                 Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    n = counts.agg(F.sum("cnt").alias("n"))
    asked = (spark.createDataFrame([(float(p),) for p in probs], "prob double").join(F.broadcast(n))
             .withColumn("at", F.col("prob") * (F.col("n") - 1))
             .select("prob", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("place")))
    running = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = (counts.join(F.broadcast(parts.select("part", "before")), "part")
            .withColumn("upto", F.col("before") + F.sum("cnt").over(running)))
    # the few asked places (two per probability) meet the ranges of places of every value
    found = (upto.join(F.broadcast(asked), (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("cnt")))
             .groupBy("prob", "at").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    return (spark.createDataFrame([(float(p),) for p in probs], "prob double").join(F.broadcast(found), "prob", "left")
            .select("prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("quantile")))


def law_distances(counts: DataFrame, laws: DataFrame, key: str) -> DataFrame:
    """(key, law, ks): Kolmogorov-Smirnov distance of each law(key, law, method, shape,
    loc, scale) from the key's counts. A delay of v whole seconds was anywhere in
    (v - 1, v], so the steps are compared at whole seconds only."""
    upto = Window.partitionBy(key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    share = (counts.withColumns({"_upto": F.sum("cnt").over(upto), "_n": F.sum("cnt").over(Window.partitionBy(key))})
             .select(key, F.col("value").cast("double").alias("_x"), (F.col("_upto") / F.col("_n")).alias("_share"),
                     ((F.col("_upto") - F.col("cnt")) / F.col("_n")).alias("_below")))
    shape = F.when(F.col("method") != "point", F.col("shape"))
    # just below a step the empirical share is that of the values before
    j = share.join(laws, key).withColumns({"_at": gamma_cdf_udf(F.col("_x"), shape, F.col("loc"), F.col("scale")),
                                           "_before": gamma_cdf_udf(F.col("_x") - 1, shape, F.col("loc"), F.col("scale"))})
    gap = F.greatest(F.abs(F.col("_at") - F.col("_share")),
                     F.when(F.col("method") != "point", F.abs(F.col("_before") - F.col("_below"))).otherwise(0.0))
    return j.groupBy(key, "law").agg(F.max(gap).alias("ks"))


def candidate_laws(counts: DataFrame, key: str, loc_pad: float = DEFAULT_LOC_PAD,
                   shares: tuple[float, ...] = PROFILE_SHARES) -> DataFrame:
    """(key, law, n, method, shape, loc, scale): the location-fixed fit (law 0), a
    profile over the location (the likeliest shape and scale for each location tried),
    and the law of the sample's moments (last)."""
    per = Window.partitionBy(key)
    spread = (F.max("value").over(per) - F.min("value").over(per)).cast("double")
    pads = F.array(F.lit(float(loc_pad)), *[F.greatest(spread * s, F.lit(float(loc_pad))) for s in shares])
    tried = counts.withColumn("_pads", pads).select(key, "value", "cnt", F.posexplode("_pads").alias("law", "pad"))
    of = F.struct(F.col(key).alias(key), F.col("law").alias("law")).alias("_of")
    fits = fit_gamma(stats_from_counts(tried.select(of, "value", "cnt", "pad"), "_of", F.col("pad")))
    names = ["n", "method", "shape", "loc", "scale"]
    fitted = fits.select(F.col(f"_of.{key}").alias(key), F.col("_of.law").alias("law"),
                         *names, "mean_shift", "var", "x_min")
    # free location by moments, skewed enough to start at the least delay: shape from mean and variance
    first = fitted.where("law = 0 AND var > 0")
    moments = first.select(key, F.lit(len(shares) + 1).alias("law"), "n", F.lit("moments").alias("method"),
                           (F.col("mean_shift") * F.col("mean_shift") / F.col("var")).alias("shape"),
                           (F.col("x_min") - F.lit(float(loc_pad))).alias("loc"),
                           (F.col("var") / F.col("mean_shift")).alias("scale"))
    return (fitted.withColumn("method", F.when((F.col("law") > 0) & (F.col("method") == "mle"), "profile").otherwise(F.col("method")))
            .select(key, "law", *names).unionByName(moments))


def choose_laws(counts: DataFrame, key: str, loc_pad: float = DEFAULT_LOC_PAD,
                shares: tuple[float, ...] = PROFILE_SHARES) -> DataFrame:
    """(key, n, method, shape, loc, scale, ks, ks_fixed): per key the law nearest to its
    counts (A11); ties go to the earlier candidate. ``ks_fixed`` is the distance of the
    location-fixed fit, which many ties at the least delay pull to small shapes.

    A key has at most as many counts as there are whole seconds in the delays' range,
    however often it was observed."""
    # a row per key and candidate, used twice
    laws, _ = write_counted(candidate_laws(counts, key, loc_pad, shares), "delay-laws")
    judged = laws.join(law_distances(counts, laws, key), [key, "law"])
    best = F.min_by(F.struct("n", "method", "shape", "loc", "scale", "ks"), F.struct("ks", "law")).alias("b")
    return (judged.groupBy(key).agg(best, F.min(F.when(F.col("law") == 0, F.col("ks"))).alias("ks_fixed"))
            .select(key, "b.*", "ks_fixed"))
