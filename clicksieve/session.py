"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

# Timestamps at rest carry no zone. Casting them for arithmetic is only stable
# when every session agrees on the zone, so the library pins UTC.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows of logs compress to a few bytes in a shuffle and take hundreds when a
    # task sorts them: small partitions, and enough of them to be put together.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # After a window the rows are already sorted by address; aggregating them in
    # that order is cheaper than hashing and needs no memory per address.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # Keyed state of a stream is kept in RocksDB only, and so not limited by the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Spark's own value, for queries after one that has set a smaller one.
    ARROW_BATCH: "64m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a given session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches on one machine.

    A cluster submits its own session with its own sizes; there
    ``spark.sql.shuffle.partitions`` should be set so that one shuffle
    partition holds 128-256 MB (AQE merges the ones that turn out smaller).
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("clicksieve")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # call sites for error messages cost more than building a short plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written intermediates, reachable by every executor.

    The parent is the folder the cluster names in ``spark.checkpoint.dir``.
    Only a local-mode session may go without one: there the driver and the
    executors are one process and share the temporary folder.
    """
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="clicksieve-")
    folder = f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    # intermediates go when the session's JVM ends
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder
