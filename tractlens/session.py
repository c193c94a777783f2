"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "tractlens") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRACTLENS_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder the cluster names; only a session on one machine may do without.

    Executors of a cluster do not see each other's disks, so a temporary folder there would lose
    rows on the way back: without the setting this raises.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get(CHECKPOINT_KEY, None)
    master = spark.sparkContext.master
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on {master}")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables inside the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
