"""Session construction and cluster-safe lineage cutting.

Every operator in the package is a plain ``DataFrame -> DataFrame`` function; this module only
builds a session with the settings the operators assume (UTC, AQE with skew handling) and gives
the iterative operators written tables to cut lineage, which survive executor loss.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. AQE re-plans joins and coalesces partitions at runtime, and its
# skew-join split handles hot keys on sort-merge joins (one entity / article holding a large share
# of rows). The session time zone is pinned so epoch conversions agree with the SQL oracle.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    # checkpoint files of round state are removed once the DataFrame is no longer referenced, so
    # iterative jobs do not fill the shared checkpoint folder
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "mentiongraph", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("MENTIONGRAPH_DRIVER_MEMORY", "12g")
        conf["spark.ui.enabled"] = "false"
        conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the cluster names none (local tests) is a folder set here. On a cluster this must be
    a shared file system path, so executor loss never loses a cut lineage.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir: executors do not share the driver's disk")
        configured = os.environ.get("MENTIONGRAPH_CHECKPOINT_DIR") or "/tmp/mentiongraph-checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "round") -> DataFrame:
    """Cut lineage by writing a parquet table under the shared checkpoint folder and reading it back.

    Unlike ``checkpoint()``, the re-read frame carries no reference to the plan that produced it, so
    loops that feed each round's output into the next keep a constant-size plan.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ALL_JOIN_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _set(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession):
    """Inside it, Spark deletes the shuffle files of a statement when the statement ends, not when the driver next collects garbage."""
    return _set(spark, FREE_SHUFFLES, "true")


def joined_in_place(spark: SparkSession):
    """Inside it, sides that both lie by some of the join's keys are joined as they lie, without an exchange by all keys."""
    return _set(spark, ALL_JOIN_KEYS, "false")


class Scratch:
    """Writes tables under the folder of ``spark.checkpoint.dir`` and deletes them by name."""

    def __init__(self, spark: SparkSession, free_shuffles: bool = False, codec: str | None = None):
        """``free_shuffles``: a write frees its shuffle files at once; for frames that no later statement shuffles again.
        ``codec``: the tables' compression, the session's without it."""
        self.spark, self.paths, self.free_shuffles, self.codec = spark, {}, free_shuffles, codec

    def write(self, name: str, df: DataFrame, in_place: bool = False) -> DataFrame:
        """Write ``df`` and read it back; an older table of that name is deleted after the write. ``in_place``: see ``joined_in_place``."""
        old, path = self.paths.get(name), scratch_path(self.spark, name)
        with freed_shuffles(self.spark) if self.free_shuffles else nullcontext(), joined_in_place(self.spark) if in_place else nullcontext():
            df.write.parquet(path, compression=self.codec)
        self.paths[name] = path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.paths.pop(name, None)
            if path:
                self._delete(path)

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*(name for name in list(self.paths) if name not in names))
