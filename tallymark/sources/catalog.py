"""Views over table metadata and sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.sources.readers import list_files

SAMPLE_ROWS = 5


def table_info(df: DataFrame, name: str, order: Sequence[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """First ``n`` rows by ``order``, each with the table's row and column count."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order).limit(n).select(
        F.lit(name).alias("table_name"), rows.alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"), "*")


def table_schema(df: DataFrame, name: str) -> DataFrame:
    """Name, type and nullability of each column; no scan."""
    rows = [(name, i + 1, f.name, f.dataType.simpleString(), f.nullable)
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "table_name string, position int, column_name string, type string, "
              "nullable boolean")


def catalog_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, column count and ordered column names of every table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count",
            F.lit(len(df.columns)).cast("bigint").alias("column_count"),
            F.lit(",".join(df.columns)).alias("columns"))
        for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def manifest_usage(manifest: DataFrame) -> DataFrame:
    """Files and bytes of each chat by its upload manifest."""
    return manifest.groupBy("chat_id").agg(F.count(F.lit(1)).alias("file_count"),
                                           F.sum("size_bytes").alias("total_bytes"))


def storage_usage(spark: SparkSession, root: str, chat: str | None = None) -> DataFrame:
    """Files and bytes of each chat's workspace, the folders directly below ``root``.

    Only names and sizes are listed, for one chat if asked.
    """
    below = F.regexp_extract("path", rf"^.*{_tail(root)}/([^/]+)", 1)
    folder = root if chat is None else f"{root.rstrip('/')}/{chat}"
    return (list_files(spark, folder).groupBy(below.alias("chat_id"))
            .agg(F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("total_bytes")))


def _tail(root: str) -> str:
    """Last path component, escaped for a regular expression."""
    last = root.rstrip("/").rsplit("/", 1)[-1]
    return "".join(ch if ch.isalnum() else f"\\{ch}" for ch in last)
