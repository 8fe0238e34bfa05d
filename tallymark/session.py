"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. Cluster sizing (executors, memory,
# shuffle partitions) is left to the caller; AQE coalesces and splits at runtime.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python call site of every expression makes plans of many
    # columns slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Steps that keep a row per key in memory: what one task reads stays this small while
# the input grows. Spark's own 64 and 128 MB are of packed bytes; long keys take
# twenty times that in a hash table.
SMALL_TASKS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.files.maxPartitionBytes": "32MB",
}

# Joins that need few rows of a wide table: a Bloom filter of the other side's keys (4 MB at
# most, whatever the size of the tables) keeps most others from being shuffled. Spark makes
# one where a condition on the narrow side is likely to drop rows; by default only from 10 GB on.
# The narrow side grows with the input too, so it is broadcast at no size.
KEYS_FIRST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "16GB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "33554432",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallymark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # One machine: a folder of its own is shared by all its threads.
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent (tests, a laptop) the SQL warehouse, which
    executors share as well, takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Holds session settings while jobs run, and puts back what was there."""
    held = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


def stage_table(df, label: str, small_tasks: bool = False, keys_first: bool = False):
    """Write ``df`` once to the shared folder and read it back.

    Used where several aggregations share an expensive input: the lineage is
    cut by files that outlive any executor. The files go when the driver ends.
    ``small_tasks`` is for steps whose memory goes with the keys of a task,
    ``keys_first`` for joins that drop most rows of a wide side.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    # What the write shuffled has served once it is done: its files need not wait
    # for the driver to collect its garbage.
    with settings(spark, {FREE_SHUFFLES: "true", **(SMALL_TASKS if small_tasks else {}),
                          **(KEYS_FIRST if keys_first else {})}):
        df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Has the folder go when the driver ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
