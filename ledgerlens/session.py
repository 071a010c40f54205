"""Session conventions shared by the library, the tests and bench.py."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "ledgerlens") -> SparkSession:
    """Local session with the conventions the operators assume (UTC, AQE, no UI)."""
    builder = (
        SparkSession.builder.master(master or os.environ.get("SPARK_MASTER", "local[8]"))
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Text stages are CPU-bound: keep small post-shuffle partitions apart so
        # they spread over the cores (large tables are unaffected).
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the value conventions to a session someone else built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # rows hold whole texts: small Arrow batches bound the memory of JVM buffers and Python workers
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once per Spark application.

    Arrow functions are pickled by module name, so every worker must be able to import the package
    wherever the driver was started from.
    """
    context = spark.sparkContext
    if getattr(context, "_ledgerlens_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-src-"), "ledgerlens-src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    context._ledgerlens_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    Only in local mode may it be unset (tests): then a private folder is made and set.  Whoever owns the
    folder removes what is written there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured.replace("file:", "") if configured.startswith("file:/") else configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df):
    """Round-robin a scan over the cluster's cores when it arrives in fewer partitions.

    CPU-heavy row-local work (regex, splitting, chunking) runs in the scan's
    tasks; a table stored as one large row group would run it on one core.  When
    the scan already has at least ``defaultParallelism`` partitions (the normal
    case for a large table) this is a no-op and adds no shuffle.
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session): leave the scan as is
        return df
    return df.repartition(target) if parts < target else df


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and cut its lineage (``checkpoint``, eager).

    For a small derived table that several branches of one plan read (scores
    before a correlation, reactions before their summary): the expensive
    upstream work runs once, and a lost executor re-reads the written files
    instead of recomputing the upstream stages.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
