"""Spark session defaults for the engine.

Correctness against the SQL oracle needs a UTC session clock and ANSI mode; scale needs AQE
(runtime coalescing, skew-join splitting, broadcast conversion with a measured size) and a
shared checkpoint folder. A cluster names that folder in ``spark.checkpoint.dir``; we only set
one when the session has none (local tests).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: On one machine only: text stages are CPU-bound per row, so small inputs should spread over every core. A cluster keeps its own.
LOCAL_CONF = {
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
}


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the engine relies on to an existing session."""
    for k, v in (ENGINE_CONF | (LOCAL_CONF if is_local(spark) else {})).items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        # Only reached when nothing names a shared folder, i.e. a local test session.
        configured = tempfile.mkdtemp(prefix="hearsay-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship(spark: SparkSession) -> None:
    """Give the package's modules to the executors, once a session; they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_hearsay_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="hearsay-"), "hearsay_modules.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._hearsay_shipped = True


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "hearsay") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("HEARSAY_DRIVER_MEMORY", "16g"))
    )
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
