"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings a libsight job is designed for; pass them at session build time.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # checkpoint files go when the DataFrame that wrote them is gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # top-k per group is limited before the shuffle up to this k
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(app: str = "libsight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only where the session names none (tests, local runs) a temporary folder is
    set, since there driver and executors are one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Functions that run in tasks are pickled by reference, so the workers must be
    able to import the package.
    """
    context = spark.sparkContext
    if not getattr(context, "_libsight_shipped", False):
        root = Path(__file__).resolve().parent
        base = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.addPyFile(shutil.make_archive(f"{base}/libsight", "zip", root.parent, root.name))
        context._libsight_shipped = True
    return spark
