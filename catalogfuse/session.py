"""Session settings for the jobs in this package.

Only options a caller would normally tune are set here; a cluster's own values win because
``configure`` never overrides an option that is already set on the session.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# AQE does three jobs for this package: it turns shuffles into broadcasts once the real size is
# known, splits hot join keys, and coalesces small shuffle partitions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more exchange: one straggler is worse.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "catalogfuse", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for ``DataFrame.checkpoint``; None when it names none."""
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where all tasks run in the driver."""
    folder = checkpoint_dir(spark)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")
