"""Logs, manifests and questions derived from the test tables.

Each text is a template filled from its row. The same templates give the oracle
its SQL, so both engines see equal inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.workloads.views import quote, table

STAR_TABLES = ("patient_visit", "patient_visit_cpt", "cpt_codes", "payment", "visit_status")

# ``{t}`` stands for a star table, chosen by the event's number.
STATEMENTS = (
    "SELECT id, deleted_at FROM {t}",
    "SELECT id FROM {t} ORDER BY id LIMIT 4500",
    "SELECT count(credit_card) FROM {t}",
    "UPDATE {t} SET deleted_at = NULL",
    "SELECT x.id FROM {t} x CROSS JOIN visit_status s",
    "SELECT max(id) AS top FROM {t} WHERE deleted_at IS NULL LIMIT 60",
    "SELECT * FROM {t} x JOIN payment p ON x.id = p.id LEFT JOIN visit_status v ON v.id = x.id",
    "SELECT * FROM {t} x LEFT JOIN payment p ON x.id = p.id LEFT JOIN visit_status v ON v.id = x.id",
    "select count(*) from {t}, payment where limit_x = 1;",
    "  SELECT ssn FROM {t} ",
    "   ",
    "WITH q AS (SELECT 1) SELECT * FROM {t}",
    "SELECT id FROM {t} WHERE note = 'drop it'",
)

ERRORS = (
    "Binder Error: column must appear in the GROUP BY clause",
    "Unknown column 'x' in 'field list'",
    "You have an error in your SQL syntax",
    "Lost connection to server during query",
    "Table 'billing.claims' doesn't exist",
    "Invalid use of an aggregate function",
)

# ``{q}`` stands for a message of the conversations table.
QUESTIONS = (
    "{q}",
    "Weekly report for acme please: {q}",
    "KPI report --north shore clinic",
    "show charges for the client o'neil-smith, now {q}",
    "Performance report company BETA! {q}",
    "{q} for",
)

EXTENSIONS = (".xlsb", ".XLSX", ".xls", ".csv", ".tsv", ".parquet", ".exe", ".pdf", "")

SHEETS = ("Sheet {p}", "select", "   ", "A/B {p}", "Table", "Q1-2024_{p}", "net (gross) {p}")


def fill_sql(template: str, mark: str, value: str) -> str:
    """Template as a SQL concatenation, the same text in both engines."""
    pieces = template.split(mark)
    out = quote(pieces[0])
    for piece in pieces[1:]:
        out = f"concat({out}, {value}, {quote(piece)})"
    return out


def choose_sql(key: str, options) -> str:
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {key} {whens} END"


STAR_TABLE_SQL = choose_sql("CAST(event_id % 5 AS INT)", [quote(t) for t in STAR_TABLES])
STATEMENT_SQL = choose_sql(
    f"CAST(event_id % {len(STATEMENTS)} AS INT)",
    [fill_sql(s, "{t}", STAR_TABLE_SQL) for s in STATEMENTS])
ERROR_SQL = choose_sql(f"CAST(event_id % {len(ERRORS)} AS INT)", [quote(e) for e in ERRORS])
QUESTION_SQL = choose_sql(
    f"CAST((conv_id + turn) % {len(QUESTIONS)} AS INT)",
    [fill_sql(q, "{q}", "text") for q in QUESTIONS])
FILE_NAME_SQL = (f"concat(url, {choose_sql(f'CAST(page_id % {len(EXTENSIONS)} AS INT)', [quote(e) for e in EXTENSIONS])})")
SHEET_SQL = choose_sql(
    f"CAST(page_id % {len(SHEETS)} AS INT)",
    [fill_sql(s, "{p}", "CAST(page_id AS STRING)") for s in SHEETS])


def size_sql(characters: str) -> str:
    return f"CASE WHEN page_id % 17 = 0 THEN 0 ELSE {characters} * 20000 END"


SIZE_SQL = size_sql("length(html)")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(STATEMENT_SQL).alias("sql_query"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query log: one record per event; ``error`` events are failed queries."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("chat_"), (F.col("event_id") % 20).cast("string")).alias("chat_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("question "), F.col("event_id").cast("string")).alias("question"),
        F.expr(STATEMENT_SQL).alias("sql_query"), (~failed).alias("success"),
        (F.col("event_id") % 1000).alias("row_count"),
        F.col("value").alias("execution_time_seconds"),
        F.when(failed, F.expr(ERROR_SQL)).alias("error"),
        F.lit(None).cast("string").alias("metadata"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
            .select("conv_id", "turn", F.expr(QUESTION_SQL).alias("question")))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload manifest: one file per page, a minute apart.

    Spark's lengths are ints, which the bytes of a page over 107,374 characters exceed.
    """
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("file_id"), (F.col("page_id") % 40).alias("chat_id"),
        (F.col("page_id") % 8).alias("user_id"), F.expr(FILE_NAME_SQL).alias("original_name"),
        F.expr(size_sql("CAST(length(html) AS BIGINT)")).alias("size_bytes"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + page_id * INTERVAL '1' MINUTE")
        .alias("uploaded_at"))


def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(SHEET_SQL).alias("sheet_name"))
