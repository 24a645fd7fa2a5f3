"""Session construction and run-time settings that every plan relies on."""

from __future__ import annotations

import gc
import os
import re

from pyspark.sql import SparkSession

#: Settings a cluster operator may override; none of them is tied to a data size.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, driver_memory: str = "8g", **more: str) -> SparkSession:
    """A session with UTC time and adaptive execution, for tests and the bench."""
    builder = SparkSession.builder.master(master).appName("quillon")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": driver_memory} | more
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; set one only where none is set (tests, bench)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or os.path.join(os.environ.get("TMPDIR", "/tmp"), "checkpoints"))
    return context.getCheckpointDir()


def checkpointed(df, eager: bool = True):
    """Cut the lineage of df in the shared checkpoint folder, so that a lost executor costs a re-read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def release(spark: SparkSession) -> None:
    """Let go of shuffles and checkpoints that no frame refers to any more: Spark deletes their files only once the driver's
    JVM has collected them, which it may not do for as long as the plan runs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
