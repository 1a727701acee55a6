"""Session helpers: building a session for tests/bench and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Rows up to which a round of a search is a small job, and its partitions.
SMALL_ROWS = 20_000
SMALL_PARTITIONS = 4


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "transitrisk") -> SparkSession:
    """Session with the settings the engine relies on (UTC, AQE, ANSI).

    On a cluster, call ``configure(spark)`` on the session you already
    have instead; this builder is for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    spark = (builder
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             # call sites for error messages cost several milliseconds a column; iterative plans have thousands
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.driver.memory", os.environ.get("TR_DRIVER_MEMORY", "16g"))
             .getOrCreate())
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Session-level settings every job here assumes."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per context: functions that run
    in Python workers import it there."""
    sc = spark.sparkContext
    if getattr(sc, "_transitrisk_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="transitrisk-py-")), "transitrisk.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("transitrisk", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._transitrisk_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when it is
    unset (local tests) a folder of our own is chosen.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="transitrisk-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (the data is on shared storage, not on the
    executors), unlike a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # persist first: writing a reliable checkpoint otherwise recomputes the plan
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def cut_lineage_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Like ``cut_lineage`` but also returns the row count, computed while
    persisting; an empty result is returned without writing a checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    n = df.count()
    if n == 0:
        return df, 0
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out, n


@contextmanager
def small_job(spark: SparkSession, rows: int):
    """For jobs on few rows: a few partitions and no re-planning between stages, which would
    take longer than the work. Larger ones run with the session's own settings."""
    names = {"spark.sql.adaptive.enabled": "false",
             "spark.sql.shuffle.partitions": str(min(SMALL_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    before = {n: spark.conf.get(n) for n in names}
    try:
        if rows <= SMALL_ROWS:
            for n, v in names.items():
                spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, every job's shuffle files go when the job is done: iterations that write
    a table each keep no older shuffles on disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Scratch folders made since each open ``scratch_removed`` began.
_MADE: list[list[str]] = []


@contextmanager
def scratch_removed(spark: SparkSession) -> Iterator[None]:
    """At its end the tables written within it are removed from the shared folder, but for those ``kept``:
    work done in parts leaves their results alone."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
        conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm
        for p in made:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def write_counted(df: DataFrame, name: str, kept: bool = False) -> tuple[DataFrame, int]:
    """Writes a table to the shared folder and reads it back; the same job counts its rows.
    The job's shuffle files go with it: the table stands for them. ``kept``: by ``scratch_removed``."""
    path, seen = scratch_path(df.sparkSession, name), Observation()
    if _MADE and not kept:
        _MADE[-1].append(path)
    with shuffles_removed(df.sparkSession):
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows kept by the keys of joins to come, which then move their other side alone."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.repartition(n, *keys).sortWithinPartitions(*keys).cache()
    kept.count()  # how the rows are dealt is known to later plans once they are
    return kept


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
