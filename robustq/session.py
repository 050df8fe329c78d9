"""Spark session helpers.

Library code never creates its own session: every operator takes DataFrames (or a
session handed in by the caller). ``build_session`` is for tests, bench and scripts.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "robustq") -> SparkSession:
    master = master or os.environ.get("ROBUSTQ_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpointed tables (derived inputs, sorted keys, weights) are removed from the
        # checkpoint folder once no DataFrame refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ROBUSTQ_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """Driver and executors are one process (``local-cluster`` is not)."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder. A scratch folder is set only where none is named
    and the whole session runs in one process (tests); a cluster must name a shared one."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder "
                               "that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="robustq-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(conf)
    return conf
