"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for results or for skew; everything else is left to the cluster.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when the join result is shuffled again
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # limit groups before the shuffle also where many rows of a key are wanted
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # what a task reads stays the same when tables grow: many small partitions are put together up to a size
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32m",
    "spark.sql.files.maxPartitionBytes": "32m",
    # many small files: listed and read by some tasks, not by one each
    "spark.sql.files.openCostInBytes": "1m",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
}
CHECKPOINT_DIR = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Set the settings above on a session that is given; all of them can change at run time."""
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "plangauge", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and bench; on a cluster use the session that is given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets one machine-local folder, which it keeps.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    spark.conf.set(CHECKPOINT_DIR, tempfile.mkdtemp(prefix="plangauge-"))
    return spark.conf.get(CHECKPOINT_DIR)


def new_work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder name for one run; nothing is deleted or overwritten."""
    return f"{shared_dir(spark)}/plangauge/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, gives one fixed copy to read twice."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
