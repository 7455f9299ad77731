"""Session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


# settings for a cluster run (pass with --conf); sized for large shuffles, AQE does the rest
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "churnlens") -> SparkSession:
    """Local session for tests/bench. Under spark-submit (a master is already configured)
    the cluster's settings are kept and only the shared checkpoint folder is checked."""
    from pyspark import SparkConf

    configured = SparkConf().get("spark.master", None)
    if configured and master is None:
        spark = SparkSession.builder.appName(app).getOrCreate()
        ensure_checkpoint_dir(spark)
        return spark
    master = master or os.environ.get("CHURNLENS_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set a scratch one only when unset (tests)."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: the server owns the checkpoint folder
        if not conf_dir:
            raise ValueError("set spark.checkpoint.dir to a shared folder") from None
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster; "
                         "a machine-local scratch folder is only used in local mode")
    local = tempfile.mkdtemp(prefix="churnlens-ckpt-")
    sc.setCheckpointDir(local)
    return local
