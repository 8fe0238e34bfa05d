"""Incremental counts over the growing query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymark.sources.writers import PROVENANCE_SCHEMA, READ_TIME
from tallymark.streaming.clock import instant, utc_clock

# A day stays open for one more day, so records may arrive that late.
LATENESS = "1 day"


# Batches between two compactions.
COMPACT_EVERY = 20
KEYS = ("day", "success")
NEWEST = f"{KEYS[0]} date, {KEYS[1]} boolean, query_count bigint, total_seconds double"


def read_provenance_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PROVENANCE_SCHEMA).option("timestampNTZFormat", READ_TIME)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def daily_outcomes(log: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Queries per day and outcome, from a table or a stream."""
    counts = (log.withColumn("_ts", instant(log, "timestamp")).withWatermark("_ts", lateness)
              .groupBy(F.window("_ts", "1 day").alias("_w"), "success")
              .agg(F.count(F.lit(1)).alias("query_count"),
                   F.sum("execution_time_seconds").alias("total_seconds")))
    return counts.select(utc_clock(F.col("_w.start")).cast("date").alias("day"), "success", "query_count",
                         "total_seconds")


def maintain_daily_outcomes(spark: SparkSession, log_path: str, out: str, checkpoint: str,
                            available_now: bool = True, compact_every: int = COMPACT_EVERY,
                            files_per_batch: int | None = None, lateness: str = LATENESS) -> StreamingQuery:
    """Keep the latest counts of each day current in ``out``, which belongs to ``checkpoint``.

    A log whose files do not arrive in order of time needs a ``lateness`` that covers them.
    """
    def write(batch: DataFrame, number: int) -> None:
        keep_batch(batch, number, out, compact_every)

    writer = (daily_outcomes(read_provenance_stream(spark, log_path, files_per_batch), lateness).writeStream
              .outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def keep_batch(batch: DataFrame, number: int, out: str, compact_every: int = COMPACT_EVERY) -> None:
    """Write the days that a micro-batch changed, under the batch's number.

    A batch replayed after a failure overwrites its own folder, so nothing is counted
    twice. Every ``compact_every`` batches the newest row of each day and outcome goes
    to one base folder; a pointer file names it once it is whole. What the pointer
    before made obsolete is deleted then, one compaction late, so readers that follow
    the older pointer keep their files. ``out`` thus holds two bases and at most
    2 * ``compact_every`` batch folders, however long the stream runs.
    """
    spark, folder = batch.sparkSession, _Folder(batch.sparkSession, out)
    base = folder.newest("_base")
    if base is not None and number < base:
        raise ValueError(f"{out} holds batches up to {base} of another checkpoint; batch {number} is not its next")
    batch.write.mode("overwrite").parquet(folder.path(f"batch={number}"))
    if (number + 1) % compact_every or base == number:
        return
    rows = _newest_rows(spark, folder, base, number).coalesce(1)
    rows.write.mode("overwrite").parquet(folder.path(f"base={number}"))
    folder.create(f"_base/{number}")
    if base is not None:
        folder.delete(*[f"batch={n}" for n in folder.numbers("batch=") if n <= base],
                      *[f"base={n}" for n in folder.numbers("base=") if n < base],
                      *[f"_base/{n}" for n in folder.numbers("", "_base") if n < base])


def current_daily_outcomes(spark: SparkSession, out: str) -> DataFrame:
    """Newest row of each day and outcome: those of the base and of the batches after it."""
    folder = _Folder(spark, out)
    return _newest_rows(spark, folder, folder.newest("_base")).drop("batch")


def _newest_rows(spark: SparkSession, folder: _Folder, base: int | None, last: int | None = None) -> DataFrame:
    later = [n for n in folder.numbers("batch=") if (base is None or n > base) and (last is None or n <= last)]
    rows = spark.createDataFrame([], f"{NEWEST}, batch bigint")
    if base is not None:
        rows = spark.read.schema(rows.schema).parquet(folder.path(f"base={base}"))
    if later:
        rows = rows.unionByName(
            spark.read.schema(f"{NEWEST}, batch bigint").option("basePath", folder.path(""))
            .parquet(*[folder.path(f"batch={n}") for n in later]))
    newest = F.max_by(F.struct("query_count", "total_seconds", "batch"), "batch").alias("last")
    return rows.groupBy(*KEYS).agg(newest).select(*KEYS, "last.*")


class _Folder:
    """Names in a folder of any file system that Spark reads; the names are few."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._root = spark._jvm, root.rstrip("/")
        self._files = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, name: str) -> str:
        return f"{self._root}/{name}".rstrip("/")

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def numbers(self, prefix: str, inside: str = "") -> list[int]:
        """The numbers of the entries named ``prefix`` and a number, ascending."""
        if not self._files.exists(self._at(inside)):
            return []
        found = [entry.getPath().getName() for entry in self._files.listStatus(self._at(inside))]
        return sorted(int(n[len(prefix):]) for n in found if n.startswith(prefix) and n[len(prefix):].isdigit())

    def newest(self, inside: str) -> int | None:
        return max(self.numbers("", inside), default=None)

    def create(self, name: str) -> None:
        self._files.create(self._at(name), True).close()

    def delete(self, *names: str) -> None:
        for name in names:
            self._files.delete(self._at(name), True)
