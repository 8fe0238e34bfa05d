"""Scans and ingest."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import names
from tallymark.operators import profile
from tallymark.session import stage_table
from tallymark.sources.writers import write_parquet

log = logging.getLogger(__name__)

# Texts read as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
           "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Casts alone would also read a trailing "d" or "f" as a number.
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


# --- parquet --------------------------------------------------------------------------


def register_parquet(spark: SparkSession, path: str, name: str | None = None) -> str:
    """Register a Parquet file or folder as a view and return the view's name."""
    stem = re.sub(r"\.parquet$", "", path.rstrip("/").rsplit("/", 1)[-1])
    view = names.view_name(stem) if name is None else names.clean_view_name(name)
    spark.read.parquet(path).createOrReplaceTempView(view)
    return view


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path, length and time of the files below a folder, contents unread."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").load(folder)
            .select("path", "length", "modificationTime"))


def tables_below(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Paths of the tables below a folder, in order: files, or folders of part files.

    The outermost name below ``folder`` that matches is the table, whatever the names
    of the files in it; Spark's own marks (``_SUCCESS``) are not listed.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    root = system.makeQualified(path).toString().rstrip("/") + "/"
    glob = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern)
    found: dict[str, None] = {}
    for row in list_files(spark, folder).select("path").orderBy("path").collect():
        below = row["path"].removeprefix(root)
        steps = below.split("/")
        depth = next((i for i, step in enumerate(steps) if glob.matches(step)), None)
        if depth is not None:
            found[row["path"].removesuffix(below) + "/".join(steps[:depth + 1])] = None
    return list(found)


def register_folder(spark: SparkSession, folder: str, pattern: str = "*.parquet",
                    named: bool = False) -> list[str]:
    """Register every matching file, or folder of part files, of a folder; unreadable ones are skipped.

    ``named`` keeps the whole file stem as view name.
    """
    views = []
    for path in tables_below(spark, folder, pattern):
        stem = re.sub(r"\.parquet$", "", path.rsplit("/", 1)[-1])
        try:
            views.append(register_parquet(spark, path, stem if named else None))
        except Exception as error:
            log.warning("skipped %s: %s", path, error)
    return views


def copy_parquet(spark: SparkSession, path: str, out: str) -> dict:
    """Take over a Parquet upload; the row count comes from file footers."""
    spark.read.parquet(path).write.parquet(out)
    written = spark.read.parquet(out)
    return {"parquet_path": out, "row_count": written.count(),
            "column_count": len(written.columns)}


# --- delimited text ---------------------------------------------------------------------


def infer_types(df: DataFrame, dates: bool = True) -> DataFrame:
    """Cast text columns to the narrowest of bigint, double, boolean, timestamp.

    A type is chosen only if every non-null value of the column reads as it,
    checked for all columns in one aggregation over all rows.
    """
    kinds = ["bigint", "double", "boolean"] + (["timestamp_ntz"] if dates else [])

    def reads(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "double":
            return F.trim(c).rlike(NUMBER_TEXT) & c.try_cast(kind).isNotNull()
        if kind == "boolean":
            return F.lower(c).isin("true", "false")
        if kind == "timestamp_ntz":
            return c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}") & c.try_cast(kind).isNotNull()
        return c.try_cast(kind).isNotNull()

    checks = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        checks.append(F.count(c).alias(f"n{i}"))
        checks += [F.count(F.when(reads(name, k), 1)).alias(f"n{i}_{k}") for k in kinds]
    counts = df.agg(*checks).first()
    casts = {}
    for i, name in enumerate(df.columns):
        present = counts[f"n{i}"]
        kind = next((k for k in kinds if present and counts[f"n{i}_{k}"] == present), None)
        if kind:
            casts[name] = F.col(f"`{name}`").cast(kind)
    return df.withColumns(casts) if casts else df


HEADER_READERS = 16  # files whose first line is read at once
RESCUED = "_rescued"


def _headers(make_reader, files: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their header, in order; files without a line have none."""
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        rows = pool.map(lambda f: make_reader().option("header", False).csv(f).first(), files)
        found: dict[tuple[str, ...], list[str]] = {}
        for file, row in zip(files, rows):
            if row is not None:
                raw = names.number_duplicates("" if cell is None else cell for cell in row)
                found.setdefault(tuple(raw), []).append(file)
    return found


def reconciled_text(spark: SparkSession, path: str | Sequence[str], make_reader) -> DataFrame:
    """The cells of all files as text, columns matched by header name, and ``_rescued``.

    Files may order their columns differently; what a file lacks is null, what
    only later files have comes last. ``_rescued`` holds the raw line of a row
    whose number of cells is not that of its header.
    """
    files = [r["path"] for r in list_files(spark, path).select("path").orderBy("path").collect()]
    by_header = _headers(make_reader, files)
    columns = list(dict.fromkeys(c for header in by_header for c in header))
    place = {c: f"c{i}" for i, c in enumerate(columns)}
    # Plain positions as names: headers may hold any text.
    parts = []
    for header, own in by_header.items():
        schema = T.StructType([T.StructField(place[c], T.StringType()) for c in header]
                              + [T.StructField(RESCUED, T.StringType())])
        part = (make_reader().option("header", True).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", RESCUED).schema(schema).csv(own))
        kept = {c: F.when(~F.col(place[c]).isin(*MISSING), F.col(place[c])) for c in header}
        parts.append(part.select(*[kept.get(c, F.lit(None).cast("string")).alias(place[c]) for c in columns], RESCUED))
    if not parts:
        return spark.createDataFrame([], f"{RESCUED} string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withMetadata(RESCUED, {"headers": columns})


def read_delimited(spark: SparkSession, path: str | Sequence[str], delimiter: str | None = None,
                   encoding: str = "utf-8", schema=None, dates: bool = True,
                   multi_line: bool = False, rescued: str | None = None) -> DataFrame:
    """Delimited text with a header in every file.

    Comma by default, tab for ``.tsv``. Without a schema, columns are matched by the
    header of each file and types are inferred from all rows; the text is parsed
    once. Rows with too few cells are filled with nulls and surplus cells dropped,
    unless ``rescued`` names a folder: then such rows go there as they stand. Files
    are split across tasks; ``multi_line`` reads quoted fields that hold line breaks,
    one file per task.
    """
    if delimiter is None:
        delimiter = "\t" if str(path).lower().endswith(".tsv") else ","

    def make_reader():
        return (spark.read.option("header", True).option("sep", delimiter)
                .option("encoding", encoding).option("quote", '"').option("escape", '"')
                .option("multiLine", multi_line))

    if schema is not None:
        return make_reader().schema(schema).csv(path)
    text = reconciled_text(spark, path, make_reader)
    if text.columns == [RESCUED]:
        return text.select()
    raw = text.schema[RESCUED].metadata["headers"]
    text = stage_table(text, "parsed")
    if rescued is not None:
        (text.filter(F.col(RESCUED).isNotNull()).select(F.col(RESCUED).alias("line"))
         .write.mode("overwrite").parquet(rescued))
        text = text.filter(F.col(RESCUED).isNull())
    return infer_types(text.drop(RESCUED), dates).toDF(*raw)


def ingest_csv(spark: SparkSession, path: str, out: str, **options) -> dict:
    """Delimited text to Parquet with SQL-safe names."""
    df = names.rename(read_delimited(spark, path, **options), names.csv_name)
    write_parquet(df, out)
    written = spark.read.parquet(out)
    return {"parquet_path": out, "row_count": written.count(),
            "column_count": len(written.columns), "columns": written.columns}


def clean_sheet(df: DataFrame) -> DataFrame:
    """Drop rows without any value and clean the header."""
    return names.rename(df, names.sheet_column_name).na.drop("all")


def ingest_sheets(spark: SparkSession, folder: str, out: str, suffix: str = ".csv") -> list[dict]:
    """Workbook sheets exported as ``<sheet>.csv`` to one Parquet table each.

    Integers are stored in the narrowest type that holds them. Empty sheets and sheets that fail are skipped.
    """
    paths = [r["path"] for r in list_files(spark, folder, f"*{suffix}").select("path").collect()]
    sheets: dict[str, str] = {}
    for path in paths:
        # A sheet may be one file or a folder of part files.
        rest = path.split(folder.rstrip("/").split(":", 1)[-1].rstrip("/") + "/", 1)[-1]
        top = rest.split("/", 1)[0]
        sheets[top.removesuffix(suffix)] = f"{folder.rstrip('/')}/{top}"
    results = []
    for sheet, path in sorted(sheets.items()):
        try:
            df = clean_sheet(read_delimited(spark, path))
            if not df.columns or df.isEmpty():
                continue
            table = names.sheet_table_name(sheet.replace("%20", " "))
            target = f"{out.rstrip('/')}/{table}"
            write_parquet(profile.narrow(df), target)
            written = spark.read.parquet(target)
            results.append({"table_name": table, "parquet_path": target,
                            "row_count": written.count(), "column_count": len(written.columns)})
        except Exception as error:
            log.warning("skipped sheet %s: %s", sheet, error)
    return results


# --- databases -----------------------------------------------------------------------------


def jdbc_options(url: str, query: str, *, user: str | None = None, password: str | None = None,
                 driver: str | None = None, partition_column: str | None = None,
                 lower: object = None, upper: object = None, partitions: int = 1,
                 fetch_size: int = 10_000, timeout: int = 30) -> dict[str, str]:
    """Reader options for a read-only statement, split over a column if one is given."""
    text = query.strip().rstrip(";")
    if not text.upper().startswith("SELECT"):
        raise ValueError("Only SELECT queries are allowed")
    options = {"url": url, "dbtable": f"({text}) q", "fetchsize": str(fetch_size),
               "queryTimeout": str(timeout)}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partition column needs its lower and upper bound")
        options |= {"partitionColumn": partition_column, "lowerBound": str(lower),
                    "upperBound": str(upper), "numPartitions": str(partitions)}
    for key, value in (("user", user), ("password", password), ("driver", driver)):
        if value is not None:
            options[key] = value
    return options


def read_jdbc(spark: SparkSession, url: str, query: str, max_rows: int | None = None,
              **options) -> DataFrame:
    df = spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()
    return df if max_rows is None else df.limit(max_rows)
