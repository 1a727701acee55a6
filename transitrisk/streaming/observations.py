"""Daily stop-level actuals as a stream (S3 + P1-P5 + A2, incremental).

New daily files dropped into a folder are parsed by the same normalizer
as the batch path, and the per-(trip, day, times, stop) delay statistics
are kept as a running streaming aggregate. The state holds sums, not
lists, so it stays bounded by the number of timetable rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from transitrisk.operators.timetable import GROUP_KEY
from transitrisk.session import scratch_path
from transitrisk.sources.actuals import ACTUALS_COLUMNS, normalize_actuals

# Fixed value: the column order of the daily files (header names).
FILE_COLUMNS = ["BETRIEBSTAG", "FAHRT_BEZEICHNER", "BETREIBER_ID", "BETREIBER_ABK", "BETREIBER_NAME",
                "PRODUKT_ID", "LINIEN_ID", "LINIEN_TEXT", "UMLAUF_ID", "VERKEHRSMITTEL_TEXT",
                "ZUSATZFAHRT_TF", "FAELLT_AUS_TF", "BPUIC", "HALTESTELLEN_NAME", "ANKUNFTSZEIT",
                "AN_PROGNOSE", "AN_PROGNOSE_STATUS", "ABFAHRTSZEIT", "AB_PROGNOSE", "AB_PROGNOSE_STATUS",
                "DURCHFAHRT_TF"]


def read_actuals_stream(spark: SparkSession, folder: str, columns: list[str] = FILE_COLUMNS,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of ';'-separated daily files with a fixed text schema."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    r = spark.readStream.schema(schema).option("sep", ";").option("header", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.csv(folder)
    present = set(columns)
    return raw.select(*[(F.col(s) if s in present else F.lit(None).cast("string")).alias(d)
                        for s, d in ACTUALS_COLUMNS.items()])


def running_delay_stats(obs: DataFrame) -> DataFrame:
    """Streaming A2: mean, sample std and count of the arrival delay."""
    return obs.groupBy(*GROUP_KEY).agg(
        F.avg("arrival_delay").alias("mean_delay"),
        F.stddev_samp("arrival_delay").alias("std_delay"),
        F.count("arrival_delay").cast("int").alias("num_delays"),
        F.avg("departure_delay").alias("mean_dep_delay"))


def start_delay_stats(spark: SparkSession, folder: str, sink: str = "memory", name: str = "delay_stats",
                      out_path: str | None = None, checkpoint: str | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Starts the stream. ``sink='memory'`` registers a table ``name`` (tests,
    notebooks); ``sink='parquet'`` rewrites ``out_path`` after every batch.
    The checkpoint goes to the session's shared checkpoint folder unless given.
    """
    stats = running_delay_stats(normalize_actuals(read_actuals_stream(spark, folder)))
    ckpt = checkpoint or scratch_path(spark, f"stream-{name}")
    w = stats.writeStream.outputMode("complete").option("checkpointLocation", ckpt)
    if available_now:
        w = w.trigger(availableNow=True)
    if sink == "memory":
        return w.format("memory").queryName(name).start()
    if out_path is None:
        raise ValueError("out_path is required for the parquet sink")

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    return w.foreachBatch(write).start()
