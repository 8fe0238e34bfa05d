"""Request-rate breaches: the same windowed counts over tables and streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymark.streaming.clock import instant, utc_clock

# Name -> (window, most requests allowed in it).
RATE_LIMITS = {
    "upload_per_hour": ("1 hour", 30),
    "upload_burst": ("1 minute", 10),
    "chat_per_hour": ("1 hour", 300),
    "chat_per_day": ("1 day", 5000),
    "chat_burst": ("1 minute", 30),
    "delete_per_hour": ("1 hour", 100),
    "delete_burst": ("1 minute", 20),
    "default_per_hour": ("1 hour", 1000),
}

LATENESS = "10 minutes"
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}


def rate_breaches(events: DataFrame, window: str, limit: int, key: str = "user_id",
                  ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Keys with more than ``limit`` events in a tumbling, epoch-aligned window.

    On a stream, a window is emitted once the watermark passes its end, and
    later rows for it are dropped; state holds one counter per key and open
    window.
    """
    counts = (events.withColumn("_ts", instant(events, ts)).withWatermark("_ts", lateness)
              .groupBy(F.window("_ts", window).alias("_w"), F.col(key)).count())
    return counts.filter(F.col("count") > limit).select(
        F.col(key), utc_clock(F.col("_w.start")).alias("window_start"),
        utc_clock(F.col("_w.end")).alias("window_end"),
        F.col("count").alias("request_count"))


def named_breaches(events: DataFrame, name: str, **options) -> DataFrame:
    return rate_breaches(events, *RATE_LIMITS[name], **options)


def _seconds(window: str) -> int:
    number, unit = window.split()
    return int(number) * UNIT_SECONDS[unit.rstrip("s")]


def all_breaches(events: DataFrame, limits: Mapping[str, tuple[str, int]] = RATE_LIMITS,
                 key: str = "user_id", ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Breaches of every limit, by its name, from one pass over the events.

    Events are counted in the shortest window, and these counts are added up to the
    longer ones, which must be multiples of it. On a stream, each window is emitted
    once, when the watermark passes its own end: a burst is known within minutes
    although days are counted too. Late rows are dropped where the shortest windows
    are counted and nowhere else, so all limits judge the same rows. State holds a
    counter per key and open window. Rows without a time are in no window; a null key
    is a key.
    """
    sizes = sorted({_seconds(window) for window, _ in limits.values()})
    if any(size % sizes[0] for size in sizes):
        raise ValueError(f"windows must be multiples of {sizes[0]} seconds")
    counts = (events.withColumn("_ts", instant(events, ts)).withWatermark("_ts", lateness)
              .groupBy(F.window("_ts", f"{sizes[0]} seconds").alias("_w"), F.col(key).alias("_key"))
              .agg(F.count(F.lit(1)).alias("_n")))
    broken = F.filter(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_seconds(w)).alias("size"),
                                         F.lit(n).alias("most")) for name, (w, n) in limits.items()]),
                      lambda one: (one["size"] == F.col("size")) & (F.col("n") > one["most"]))
    return _longer_windows(counts, sizes).select(F.explode(broken).alias("one"), "*").select(
        F.col("one.name").alias("limit_name"), F.col("_key").alias(key), _clock("begin").alias("window_start"),
        _clock(F.col("begin") + F.col("size")).alias("window_end"), F.col("n").alias("request_count"))


def _clock(seconds: Column | str) -> Column:
    return utc_clock(F.timestamp_seconds(seconds))


def _longer_windows(counts: DataFrame, sizes: list[int]) -> DataFrame:
    """_key, size, begin (seconds) and n of the windows of all sizes.

    A time window has one length, but a session may end where its row says: here, at
    the end of the row's window of each size. So one aggregation holds all sizes and
    closes each window at its own end.
    """
    micros = F.unix_micros("_at")
    span = F.col("size") * 1_000_000
    rows = (counts.select("_key", "_n", F.window_time("_w")).withColumnRenamed("window_time(_w)", "_at")
            .withColumn("size", F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes])))
            .withColumn("begin", F.floor(micros / span) * F.col("size"))
            .withColumn("left", (F.col("begin") + F.col("size")) * 1_000_000 - micros))
    rest = F.make_interval(secs=(F.col("left").cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))
    return (rows.groupBy("_key", "size", "begin", F.session_window("_at", rest))
            .agg(F.sum("_n").alias("n")).select("_key", "size", "begin", "n"))


def stream_to_parquet(df: DataFrame, out: str, checkpoint: str,
                      available_now: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet folder; state lives in the checkpoint."""
    writer = df.writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(out)
