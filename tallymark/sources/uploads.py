"""From an uploaded file to registered, profiled tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import names
from tallymark.functions import text as X
from tallymark.operators import governance as G
from tallymark.operators import profile as P
from tallymark.sources import readers, writers

MANIFEST_SCHEMA = (
    "file_id string, chat_id string, user_id string, original_name string, "
    "sanitized_name string, extension string, size_bytes bigint, uploaded_at timestamp_ntz, "
    "tables array<string>, status string")


def read_manifest(spark: SparkSession, workspace: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{workspace.rstrip('/')}/manifest")


def process_upload(spark: SparkSession, path: str, workspace: str, chat_id: str, user_id: str,
                   original_name: str | None = None, max_file_bytes: int = G.MAX_FILE_BYTES,
                   profile: bool = True) -> dict:
    """Check an upload, convert it by its extension, register and profile its tables.

    Delimited text and Parquet give one table, a workbook (a folder of exported
    sheets) one per sheet. The manifest gets one row. Limits on files per chat
    and bytes per user need all uploads at once: see ``validate_uploads``.
    """
    original_name = original_name or path.rstrip("/").rsplit("/", 1)[-1]
    raw = F.lit(original_name)
    name, suffix = spark.range(1).select(X.sanitize_filename(raw), X.extension(raw)).first()
    size = readers.list_files(spark, path).agg(F.sum("length")).first()[0] or 0
    if size == 0:
        raise ValueError("File is empty")
    if size > max_file_bytes:
        raise ValueError(f"File too large: {size / G.MEGABYTE:.2f}MB. "
                         f"Maximum allowed: {max_file_bytes / G.MEGABYTE:.2f}MB")
    if suffix not in X.SUPPORTED_EXTENSIONS:
        raise ValueError(f"Unsupported file format: {suffix}. "
                         f"Supported formats: {', '.join(X.SUPPORTED_EXTENSIONS)}")

    file_id = str(uuid.uuid4())
    home = f"{workspace.rstrip('/')}/{chat_id}"
    out = f"{home}/processed/{file_id}"
    stem = name.removesuffix(suffix)
    if suffix in (".csv", ".tsv"):
        delimiter = "\t" if suffix == ".tsv" else ","
        tables = [{"table_name": stem, **readers.ingest_csv(spark, path, f"{out}/{stem}",
                                                            delimiter=delimiter)}]
    elif suffix == ".parquet":
        tables = [{"table_name": stem, **readers.copy_parquet(spark, path, f"{out}/{stem}")}]
    else:
        tables = readers.ingest_sheets(spark, path, out)
    for t in tables:
        t["table_name"] = readers.register_parquet(spark, t["parquet_path"],
                                                   names.clean_view_name(t["table_name"]))
        if profile:
            P.full_profile(spark.table(t["table_name"]), t["table_name"]).write.mode(
                "append").partitionBy("table_name").json(f"{home}/profiles")
    row = (file_id, chat_id, user_id, original_name, name, suffix, size, dt.datetime.now(),
           [t["table_name"] for t in tables], "completed")
    writers.append_manifest(spark.createDataFrame([row], MANIFEST_SCHEMA),
                            f"{workspace.rstrip('/')}/manifest")
    return {"file_id": file_id, "original_name": original_name, "tables": tables,
            "total_rows": sum(t["row_count"] for t in tables), "total_size_bytes": size}
