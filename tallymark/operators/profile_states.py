"""Profiles that merge: states per table part, stored, so that new parts are profiled alone.

A state holds, for a column of a part, sums, extremes and two sketches: HyperLogLog
for distinct values and KLL for quantiles. States of parts add up to that of the
table. Counts, sums and extremes are exact; with the default sizes the distinct count
is within 3 % and a quantile within 1 % of its rank, in nearly all cases. The exact
profiles (``operators/profile.py``) stay the reference.

A store is a folder of states beside a ledger of the files they came from: a file
is profiled if the ledger does not hold its path, length and time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import exprs as X
from tallymark.operators import profile as P

HLL_BITS = 14
KLL_SIZE = 400
DISTINCT_ERROR = 0.03
RANK_ERROR = 0.01

# State fields and how they merge.
SUMS = ("rows", "present", "sum", "squares", "length_sum", "true_count")
LOWEST, HIGHEST = ("min", "min_length", "min_time"), ("max", "max_length", "max_time")


def _state(df: DataFrame, name: str) -> dict[str, Column]:
    kind = df.schema[name].dataType
    group = P.category(kind)
    present = P._present(df, name)
    number = present.cast("double") if group == "numeric" else None
    length = F.length(present) if group == "text" else None
    time = present.cast("timestamp_ntz") if group == "datetime" else None
    # Sketches take numbers and text; equal values have equal hashes.
    hashed = F.xxhash64(P.canonical(df, name))

    def over(c: Column | None, aggregate, kind: str) -> Column:
        return F.lit(None).cast(kind) if c is None else aggregate(c).cast(kind)

    return {
        "rows": F.count(F.lit(1)), "present": F.count(present),
        "distinct": F.hll_sketch_agg(F.when(present.isNotNull(), hashed), F.lit(HLL_BITS)),
        "min": over(number, F.min, "double"), "max": over(number, F.max, "double"),
        "sum": over(number, F.sum, "double"), "squares": over(number, lambda c: F.sum(c * c), "double"),
        "quantiles": (F.lit(None).cast("binary") if number is None
                      else F.kll_sketch_agg_double(number, F.lit(KLL_SIZE))),
        "min_length": over(length, F.min, "bigint"), "max_length": over(length, F.max, "bigint"),
        "length_sum": over(length, F.sum, "bigint"),
        "min_time": over(time, F.min, "timestamp_ntz"), "max_time": over(time, F.max, "timestamp_ntz"),
        "true_count": (X.count_where(present) if group == "boolean" else F.lit(None).cast("bigint")),
    }


def states(df: DataFrame, table_name: str, part: Column | None = None) -> DataFrame:
    """One state per column, and per ``part`` if given; one scan and one aggregation."""
    rows = df.withColumn("_part", F.lit("") if part is None else part)
    aggregates, structs = [], []
    for i, name in enumerate(df.columns):
        fields = [F.lit(table_name).alias("table_name"), F.lit(name).alias("column_name"),
                  F.lit(P.category(df.schema[name].dataType)).alias("data_category")]
        for field, c in _state(df, name).items():
            aggregates.append(c.alias(f"s{i}_{field}"))
            fields.append(F.col(f"s{i}_{field}").alias(field))
        structs.append(F.struct(*fields))
    return rows.groupBy(F.col("_part").alias("part")).agg(*aggregates).select("part", F.inline(F.array(*structs)))


def merge(parts: DataFrame) -> DataFrame:
    """One state per table and column from those of its parts."""
    quantiles = F.expr("kll_merge_agg_double(quantiles) FILTER (WHERE quantiles IS NOT NULL)")
    return parts.groupBy("table_name", "column_name").agg(
        F.max("data_category").alias("data_category"), *[F.sum(c).alias(c) for c in SUMS],
        *[F.min(c).alias(c) for c in LOWEST], *[F.max(c).alias(c) for c in HIGHEST],
        F.hll_union_agg("distinct").alias("distinct"),
        F.when(F.count("quantiles") > 0, quantiles).alias("quantiles"))


def profile(merged: DataFrame) -> DataFrame:
    """The profile that merged states stand for, one row per column."""
    n = X.to_double(F.col("present"))
    spread = F.col("squares") - F.col("sum") * F.col("sum") / n
    deviation = F.when(F.col("present") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1)))
    median = F.when(F.col("min").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)))
    nulls = F.col("rows") - F.col("present")
    return merged.select(
        "table_name", "column_name", "data_category", F.col("rows").alias("row_count"), nulls.alias("null_count"),
        F.try_divide(X.to_double(nulls) * 100.0, F.col("rows")).alias("null_percentage"),
        F.least(F.hll_sketch_estimate("distinct"), F.col("present")).alias("unique_count"),
        "min", "max", F.try_divide("sum", n).alias("mean"), median.alias("median"), deviation.alias("std"),
        "min_length", "max_length", F.try_divide(X.to_double(F.col("length_sum")), n).alias("avg_length"),
        "min_time", "max_time", X.elapsed_days(F.col("min_time"), F.col("max_time")).alias("range_days"),
        "true_count", F.when(F.col("data_category") == "boolean", F.col("present") - F.col("true_count"))
        .alias("false_count"))


# --- the store ------------------------------------------------------------------------------

LEDGER = "table_name string, path string, length bigint, modified timestamp"


def _ledger(spark: SparkSession, store: str) -> DataFrame:
    """Files whose states are stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/ledger")
    there = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)
    return spark.read.schema(LEDGER).parquet(f"{store}/ledger") if there else spark.createDataFrame([], LEDGER)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and time of every Parquet file of a table; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def refresh(spark: SparkSession, tables: dict[str, str], store: str) -> int:
    """Profile the files of ``tables`` (name -> path) that the store does not know; how many there were.

    States are written before the ledger, and only states whose file the ledger
    holds are read, so a run that fails between the two leaves nothing behind that counts.
    """
    fresh_files = 0
    for name, path in tables.items():
        known = _ledger(spark, store).where(F.col("table_name") == name)
        fresh = files_of(spark, path).join(known, ["path", "length", "modified"], "left_anti")
        listed = fresh.select(F.lit(name).alias("table_name"), "path", "length", "modified")
        # The file list of a table is on the driver whenever Spark reads it.
        found = listed.collect()
        if not found:
            continue
        rows = spark.read.parquet(*[r["path"] for r in found])
        file = F.col("_metadata.file_path")
        stamp = spark.createDataFrame(found, LEDGER)
        (states(rows, name, file)
         .join(stamp.select(F.col("path").alias("part"), "length", "modified"), "part")
         .write.mode("append").parquet(f"{store}/states"))
        stamp.coalesce(1).write.mode("append").parquet(f"{store}/ledger")
        fresh_files += len(found)
    return fresh_files


def stored_profile(spark: SparkSession, tables: dict[str, str], store: str) -> DataFrame:
    """Profile of all tables from stored states; files that are gone or were replaced no longer count."""
    present = None
    for name, path in tables.items():
        part = files_of(spark, path).select(F.lit(name).alias("table_name"), F.col("path").alias("part"), "length", "modified")
        present = part if present is None else present.unionByName(part)
    booked = _ledger(spark, store).withColumnRenamed("path", "part")
    keys = ["table_name", "part", "length", "modified"]
    # A failed run may have written states of a file twice: one state per file and column counts.
    held = (spark.read.parquet(f"{store}/states").join(booked.distinct(), keys, "left_semi")
            .join(present, keys, "left_semi").dropDuplicates([*keys, "column_name"]))
    return profile(merge(held))
