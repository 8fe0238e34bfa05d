"""Sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_GROUP_BYTES = 128 * 1024 * 1024


def storable(df: DataFrame) -> DataFrame:
    """Columns Parquet readers elsewhere may not know become text; nulls stay null."""
    odd = (T.MapType, T.StructType, T.CalendarIntervalType, T.DayTimeIntervalType,
           T.YearMonthIntervalType)
    casts = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.MapType, T.StructType)):
            casts[f.name] = F.to_json(F.col(f"`{f.name}`"))
        elif isinstance(f.dataType, odd) or isinstance(f.dataType, T.NullType):
            casts[f.name] = F.col(f"`{f.name}`").cast("string")
    return df.withColumns(casts) if casts else df


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: tuple[str, ...] = (), max_records_per_file: int = 0,
                  row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Snappy Parquet with dictionaries and statistics."""
    writer = (storable(df).write.mode(mode).option("compression", "snappy")
              .option("parquet.block.size", row_group_bytes)
              .option("parquet.enable.dictionary", "true")
              .option("maxRecordsPerFile", max_records_per_file))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: tuple[str, ...], buckets: int) -> None:
    """A table bucketed and sorted by its join keys, so later joins need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def write_profile(profile: DataFrame, path: str) -> None:
    """Profiles as JSON, one folder per table."""
    profile.write.partitionBy("table_name").json(path)


def profile_catalog(profile: DataFrame) -> DataFrame:
    """The combined catalog: columns of each profiled table."""
    return profile.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("column_count"),
        F.array_sort(F.collect_list("column_name")).alias("columns"))


PROVENANCE_SCHEMA = (
    "timestamp timestamp_ntz, chat_id string, user_id string, question string, sql_query string, "
    "success boolean, row_count bigint, execution_time_seconds double, error string, "
    "metadata string")


# Microseconds are kept; records written without a fraction are read as well.
WRITTEN_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
READ_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def append_provenance(log: DataFrame, path: str) -> None:
    """Append query records to the JSON log."""
    log.write.mode("append").option("timestampNTZFormat", WRITTEN_TIME).json(path)


def log_query(spark: SparkSession, path: str, chat_id: str, user_id: str, question: str,
              sql_query: str | None, success: bool, row_count: int | None = None,
              execution_time: float | None = None, error: str | None = None,
              metadata: str | None = None, timestamp: dt.datetime | None = None) -> None:
    """Append one record. For many, build a DataFrame and append it at once."""
    row = (timestamp or dt.datetime.now(), chat_id, user_id, question, sql_query, success,
           row_count, execution_time, error, metadata)
    append_provenance(spark.createDataFrame([row], PROVENANCE_SCHEMA), path)


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """The log without malformed lines."""
    return spark.read.schema(PROVENANCE_SCHEMA).option("mode", "DROPMALFORMED").option(
        "timestampNTZFormat", READ_TIME).json(path)


def recent_queries(log: DataFrame, limit: int = 100, ties: tuple[str, ...] = ()) -> DataFrame:
    """Newest records first."""
    return log.orderBy(F.desc("timestamp"), *[F.desc(t) for t in ties]).limit(limit)


def append_manifest(files: DataFrame, path: str) -> None:
    """Append uploads to the manifest, one folder per chat."""
    files.write.mode("append").partitionBy("chat_id").parquet(path)
