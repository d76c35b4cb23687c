"""Session helpers: defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


# Defaults for a large cluster, applied only where the launcher left them
# unset. The reports shrink the facts to small aggregates right after the
# scan, so shuffles are small except for joins that cannot broadcast; these
# keep scan splits and shuffle partitions at a size a task holds in memory,
# and let AQE coalesce the many small post-aggregation partitions.
CLUSTER_DEFAULTS = {
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
}


def apply_cluster_defaults(spark: SparkSession) -> None:
    """Set CLUSTER_DEFAULTS for keys that neither the launcher nor the session has set."""
    set_by_user = {k for k, _ in spark.sparkContext.getConf().getAll()}
    set_by_user |= {r["key"] for r in spark.sql("SET").select("key").collect()}
    for key, value in CLUSTER_DEFAULTS.items():
        if key not in set_by_user:
            spark.conf.set(key, value)


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "queuelens") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster the master and most settings come from the launcher; only
    the options below are filled in when they are not already set.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode runs every task inside the driver JVM
            builder = builder.config("spark.driver.memory", os.environ.get("QUEUELENS_DRIVER_MEMORY", "8g"))
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.master.startswith("local"):
        apply_cluster_defaults(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only when it is unset
    and the master is local (tests) is a private folder created and
    registered; on a cluster an unset folder is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for "
                               "checkpointed summaries; a machine-local folder would not survive "
                               "the loss of an executor")
        configured = tempfile.mkdtemp(prefix="queuelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured
