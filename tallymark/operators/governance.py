"""Policies over SQL, columns and uploads."""

from __future__ import annotations

import contextlib
import io
import re
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import sqltext as Q
from tallymark.functions import text as X
from tallymark.operators.running import Running, running_totals

MEGABYTE = 1024 * 1024
MAX_FILE_BYTES = 200 * MEGABYTE
MAX_FILES_PER_CHAT = 5
MAX_USER_BYTES = 500 * MEGABYTE


class QueryRefused(ValueError):
    """The statement breaks the read-only policy."""


# --- guarded SQL --------------------------------------------------------------------


def row_cap(df: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows; 999,999,999 or more means all."""
    return df if max_rows >= Q.UNLIMITED_ROWS else df.limit(max_rows)


def _without(c: Column, kind: T.DataType, denied: set[str]) -> Column | None:
    """``c`` without personal fields at any depth; None if nothing remains.

    Keys of a map are data, but text keys name fields as well, so entries under a
    personal name go; a map whose keys hold personal fields goes as a whole.
    """
    if isinstance(kind, T.StructType):
        kept = {f.name: _without(c.getField(f.name), f.dataType, denied)
                for f in kind.fields if f.name.lower() not in denied}
        kept = {n: v for n, v in kept.items() if v is not None}
        if not kept:
            return None if kind.fields else c
        return F.when(c.isNotNull(), F.struct(*[v.alias(n) for n, v in kept.items()]))
    if isinstance(kind, T.ArrayType) and _holds(kind.elementType, denied):
        if _without(F.lit(None).cast(kind.elementType), kind.elementType, denied) is None:
            return None
        return F.transform(c, lambda x: _without(x, kind.elementType, denied))
    if isinstance(kind, T.MapType):
        if _holds(kind.keyType, denied):
            return None
        if isinstance(kind.keyType, T.StringType):
            c = F.map_filter(c, lambda k, v: ~F.lower(k).isin(*denied))
        if _holds(kind.valueType, denied):
            if _without(F.lit(None).cast(kind.valueType), kind.valueType, denied) is None:
                return None
            return F.transform_values(c, lambda k, v: _without(v, kind.valueType, denied))
    return c


def _holds(kind: T.DataType, denied: set[str]) -> bool:
    """Whether a column of this kind may hold a personal field."""
    if isinstance(kind, T.StructType):
        return any(f.name.lower() in denied or _holds(f.dataType, denied) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, denied)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) or _holds(kind.keyType, denied) or _holds(
            kind.valueType, denied)
    return False


def masked(df: DataFrame, pii: Sequence[str] = Q.PII_COLUMNS) -> DataFrame:
    """``df`` without personal columns and without personal fields inside the others."""
    denied = {p.lower() for p in pii}
    if not denied:
        return df
    kept = []
    for f in df.schema.fields:
        if f.name.lower() in denied:
            continue
        name = "`" + f.name.replace("`", "``") + "`"
        c = _without(F.col(name), f.dataType, denied) if _holds(f.dataType, denied) else F.col(name)
        if c is not None:
            kept.append(c.alias(f.name))
    return df.select(*kept)


def _refused(column: str) -> QueryRefused:
    return QueryRefused(f"Query references PII column '{column}' which is not allowed")


def guard_columns(df: DataFrame, pii: Sequence[str] = Q.PII_COLUMNS,
                  mode: str = "raise") -> DataFrame:
    """Refuse a table that holds personal columns or fields, or drop them."""
    kept = masked(df, pii)
    if mode != "raise" or kept.schema.simpleString() == df.schema.simpleString():
        return kept
    denied = {p.lower() for p in pii}
    named = re.search(r"\b(" + "|".join(map(re.escape, denied)) + r")\b", df.schema.simpleString().lower())
    raise _refused(named.group(1) if named else sorted(denied)[0])


# Comments, strings (with escapes), quoted names.
_QUOTED = (r"--[^\n]*|/\*.*?\*/|\br'[^']*'|\br\"[^\"]*\"|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:``|[^`])*`")


def check_sql(sql: str, policy: Q.Policy) -> str:
    """Raise if the text breaks the policy; return it ready to run.

    A text that begins with SELECT can only be a query, and Spark's parser takes
    one statement, so the operation is decided here. The other findings are an
    early, readable refusal; masked views and ``check_joins`` decide on columns and joins.
    """
    text = sql.strip().rstrip(";").rstrip()
    if not text:
        raise QueryRefused("Empty SQL query")
    bare = re.sub(_QUOTED, " ", text, flags=re.S)
    first = re.match(r"(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)*(\w+|\S)", text, flags=re.S)
    operation = first.group(1).upper() if first else ""
    if operation not in policy.operations:
        raise QueryRefused(f"Operation '{operation}' not allowed. "
                           f"Only {', '.join(policy.operations)} operations are permitted.")
    for word in policy.forbidden:
        if re.search(rf"\b{word}\b", bare, re.I):
            raise QueryRefused(f"Forbidden keyword '{word}' detected")
    if re.search(Q.CROSS_JOIN, bare, re.I):
        raise QueryRefused("CROSS JOIN is not allowed (potential cartesian product)")
    joins = len(re.findall(r"\bJOIN\b", bare, re.I))
    if joins > policy.max_joins:
        raise QueryRefused(f"Too many JOINs ({joins}). Maximum allowed: {policy.max_joins}")
    for column in policy.pii:
        if re.search(rf"\b{re.escape(column)}\b", bare, re.I):
            raise QueryRefused(f"Query references PII column '{column}' which is not allowed")
    if policy.max_rows >= Q.UNLIMITED_ROWS:
        text = re.sub(r"\s+LIMIT\s+\d+\s*$", "", text, flags=re.I)
    return text


# Rules that would fold an equality of two tables into constants, after which a
# join that equates them could not be told from a product.
_KEEP_EQUALITIES = ",".join(f"org.apache.spark.sql.catalyst.optimizer.{rule}" for rule in (
    "ConstantPropagation", "FoldablePropagation", "ConvertToLocalRelation"))
_SETTINGS = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled")


def _named_tables(spark: SparkSession, sql: str) -> dict[str, DataFrame]:
    """The views and tables of the session whose names the text holds."""
    names = [t.name for t in spark.catalog.listTables()]
    return {n: spark.table(f"`{n}`") for n in names if re.search(rf"\b{re.escape(n)}\b", sql, re.I)}


def guard_session(spark: SparkSession, tables: Mapping[str, DataFrame], pii: Sequence[str]) -> SparkSession:
    """A session that sees only ``tables``, each masked, and reads no files by path."""
    guard = spark.newSession()
    for key in _SETTINGS:
        guard.conf.set(key, spark.conf.get(key))
    guard.conf.set("spark.sql.runSQLOnFiles", "false")
    guard.conf.set("spark.sql.optimizer.excludedRules", _KEEP_EQUALITIES)
    for name, df in tables.items():
        # Only global views pass from one session to another; this one is gone at once.
        passed = f"guard_{uuid.uuid4().hex}"
        masked(df, pii).createGlobalTempView(passed)
        try:
            guard.table(f"global_temp.{passed}").createOrReplaceTempView(f"`{name}`")
        finally:
            spark.catalog.dropGlobalTempView(passed)
    return guard


def _explained(df: DataFrame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def check_joins(df: DataFrame, policy: Q.Policy) -> None:
    """Raise for too many joins, comma joins included, and for joins that equate nothing.

    Spark explains joins without an equality of their two sides as products or
    nested loops; checks for existence are none.
    """
    head, physical = _explained(df).split("== Physical Plan ==")
    parsed, analysed = head.split("== Optimized Logical Plan ==")[0].split("== Analyzed Logical Plan ==")
    # Qualified names would reach past the masked views.
    if re.search(r"UnresolvedRelation \[[^\]]*,", parsed):
        raise QueryRefused("Only the given tables may be read")
    joins = len(re.findall(r"^[\s:+-]*Join \w", analysed, re.M))
    if joins > policy.max_joins:
        raise QueryRefused(f"Too many JOINs ({joins}). Maximum allowed: {policy.max_joins}")
    for join in re.findall(r"(?:CartesianProduct|BroadcastNestedLoopJoin)[^\n]*", physical):
        if not re.search(r"\b(LeftSemi|LeftAnti|ExistenceJoin)\b", join):
            raise QueryRefused("CROSS JOIN is not allowed (potential cartesian product)")


def guarded_sql(spark: SparkSession, sql: str, policy: Q.Policy = Q.FILE_POLICY,
                tables: Mapping[str, DataFrame] | None = None, mode: str = "raise") -> DataFrame:
    """Result of a read-only statement under the policy, as a lazy DataFrame.

    The statement runs over masked views of ``tables`` (or of the session's own
    views and tables), so personal columns and fields are out of its reach,
    whatever it calls them. With ``mode`` "raise" it is refused if its result
    would have held some; with "mask" it gets the rest.
    """
    text = check_sql(sql, policy)
    tables = _named_tables(spark, text) if tables is None else dict(tables)
    guard = guard_session(spark, tables, policy.pii)
    try:
        df = guard.sql(text)
    except AnalysisException as error:
        said = str(error).lower()
        for column in policy.pii:
            if re.search(rf"\b{re.escape(column.lower())}\b", said):
                raise _refused(column) from None
        raise
    check_joins(df, policy)
    if mode == "raise" and any(_shape(masked(t, policy.pii)) != _shape(t) for t in tables.values()):
        if _shape(guard_session(spark, tables, ()).sql(text)) != _shape(df):
            raise _refused(policy.pii[0] if len(policy.pii) == 1 else ", ".join(policy.pii))
    return row_cap(df, policy.max_rows)


def _shape(df: DataFrame) -> str:
    return df.schema.simpleString()


def run_guarded_sql(spark: SparkSession, sql: str,
                    policy: Q.Policy = Q.Policy(pii=Q.PII_COLUMNS)) -> dict:
    """Rows of a guarded statement with their count, columns and time taken.

    Rows come to the driver, so the policy must cap them.
    """
    if policy.max_rows >= Q.UNLIMITED_ROWS:
        raise ValueError("use guarded_sql for results without a row cap")
    started = time.monotonic()
    try:
        df = guarded_sql(spark, sql, policy)
        rows = [r.asDict() for r in df.collect()]
    except Exception as error:  # the caller reads the reason instead of a trace
        return {"success": False, "error": str(error), "query": sql,
                "execution_time_seconds": time.monotonic() - started}
    return {"success": True, "rows": rows, "row_count": len(rows), "column_names": df.columns,
            "execution_time_seconds": time.monotonic() - started, "query": sql}


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON text: nulls written out, NaN as null, ISO times."""
    clean = [F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")).alias(n)
             if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes]
    options = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss",
               "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    return df.select(F.to_json(F.struct(*clean), options).alias("json"))


# --- audits --------------------------------------------------------------------------


def audit_sql_log(df: DataFrame, sql_column: str,
                  policy: Q.Policy = Q.Policy(pii=Q.PII_COLUMNS)) -> DataFrame:
    """Policy findings for every statement of a log; no row leaves its task.

    Findings are columns of their own before the verdict reads them, so each
    pattern runs once per statement.
    """
    text = df.withColumn("_sql", Q.strip(F.col(sql_column))).withColumn("_upper", F.upper("_sql"))
    sql, upper = F.col("_sql"), F.col("_upper")
    found = text.select(
        "*", Q.operation(sql).alias("operation"),
        Q.first_hit(upper, policy.forbidden).alias("forbidden_word"),
        Q.join_count(upper).cast("bigint").alias("join_count"),
        upper.rlike(Q.CROSS_JOIN).alias("has_cross_join"),
        Q.first_hit(F.lower(sql), [p.lower() for p in policy.pii]).alias("pii_column"),
        Q.limit_value(upper).cast("bigint").alias("limit_value"),
        F.array_join(Q.tables(sql), ",").alias("tables"))
    error = Q.verdict(sql, policy, operation=F.col("operation"), word=F.col("forbidden_word"),
                      cross=F.col("has_cross_join"), joins=F.col("join_count"),
                      pii=F.col("pii_column"))
    judged = found.withColumn("error", error).withColumn("valid", F.col("error").isNull())
    return judged.withColumn("sanitized_sql", F.when(
        F.col("valid"), Q.capped_sql(sql, policy.max_rows))).drop("_sql", "_upper")


def sql_tables(df: DataFrame, sql_column: str) -> DataFrame:
    """Distinct tables a log reads from."""
    return (df.select(F.explode(Q.tables(F.col(sql_column))).alias("table_name"))
            .distinct())


def table_usage(df: DataFrame, sql_column: str) -> DataFrame:
    """How many statements read from each table."""
    return (df.select(F.explode(Q.tables(F.col(sql_column))).alias("table_name"))
            .groupBy("table_name").agg(F.count(F.lit(1)).alias("usage_count")))


def error_triage(df: DataFrame, error_column: str,
                 words: Sequence[str] = Q.DATABASE_RETRY_WORDS) -> DataFrame:
    """Failed statements by the phrase that makes them worth a retry."""
    error = F.col(error_column)
    word = Q.retry_word(error, words)
    return (df.filter(error.isNotNull() & (error != ""))
            .groupBy(F.coalesce(word, F.lit("none")).alias("error_class"))
            .agg(F.count(F.lit(1)).alias("query_count"))
            .withColumn("retryable", F.col("error_class") != "none"))


# --- uploads --------------------------------------------------------------------------


def validate_uploads(manifest: DataFrame, bucket: Column, order: Sequence[str] = ("uploaded_at", "file_id"),
                     max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Verdict for each file of an upload manifest.

    Needs ``chat_id``, ``user_id``, ``original_name`` and ``size_bytes``. Quotas
    charge files in upload order; files refused on their own account are not
    charged. ``bucket`` is a non-decreasing function of the order (such as the
    upload hour) that bounds how many files one task ranks.
    """
    name, size = F.col("original_name"), F.col("size_bytes")
    suffix = X.extension(name)
    sound = (size > 0) & (size <= max_file_bytes) & suffix.isin(*X.SUPPORTED_EXTENSIONS)
    files = manifest.select("*", X.sanitize_filename(name).alias("sanitized_name"),
                            suffix.alias("extension"), sound.alias("_sound"))
    charged_file = F.when(F.col("_sound"), 1).otherwise(0)
    charged_bytes = F.when(F.col("_sound"), F.col("size_bytes")).otherwise(0)
    files = running_totals(files, order, bucket, Running(["chat_id"], {"_files": charged_file}),
                           Running(["user_id"], {"_bytes": charged_bytes}))
    files = (files.withColumn("prior_files", F.col("_files") - charged_file)
             .withColumn("prior_bytes", F.col("_bytes") - charged_bytes))
    verdict = (F.when(F.col("size_bytes") == 0, "empty")
               .when(F.col("size_bytes") > max_file_bytes, "too_large")
               .when(F.col("prior_files") >= MAX_FILES_PER_CHAT, "too_many_files")
               .when(F.col("prior_bytes") + F.col("size_bytes") > MAX_USER_BYTES, "quota_exceeded")
               .when(~F.col("extension").isin(*X.SUPPORTED_EXTENSIONS), "unsupported_format")
               .when(F.col("extension").isin(*X.DANGEROUS_EXTENSIONS), "dangerous_type")
               .otherwise("accepted"))
    return (files.withColumn("verdict", verdict)
            .withColumn("message", _refusal(max_file_bytes)).drop("_sound", "_files", "_bytes"))


def _refusal(max_file_bytes: int) -> Column:
    """Why a file is refused, in words; null if it is accepted."""
    def megabytes(c: Column) -> Column:
        return F.concat(X.two_decimals(c / MEGABYTE), F.lit("MB"))

    def said(verdict: str, *parts) -> Column:
        return F.when(F.col("verdict") == verdict, F.concat(
            *[F.lit(p) if isinstance(p, str) else p for p in parts]))

    size, suffix = F.col("size_bytes"), F.col("extension")
    formats = ", ".join(X.SUPPORTED_EXTENSIONS)
    return F.coalesce(
        said("empty", "File is empty"),
        said("too_large", "File too large: ", megabytes(size), ". Maximum allowed: ",
             megabytes(F.lit(max_file_bytes))),
        said("too_many_files", f"Maximum files per chat ({MAX_FILES_PER_CHAT}) exceeded"),
        said("quota_exceeded", "User storage quota exceeded. Current: ",
             megabytes(F.col("prior_bytes")), ", File: ", megabytes(size), ", Limit: ",
             megabytes(F.lit(MAX_USER_BYTES))),
        said("dangerous_type", "File type not allowed for security reasons: ", suffix),
        said("unsupported_format", "Unsupported file format: ", suffix,
             f". Supported formats: {formats}"))


def quota_usage(manifest: DataFrame) -> DataFrame:
    """Files per chat and bytes per user against their limits."""
    def usage(key, scope, measure, limit):
        used = F.col("used")
        return manifest.groupBy(key).agg(measure.cast("bigint").alias("used")).select(
            F.lit(scope).alias("scope"), F.col(key).cast("string").alias("owner"), "used",
            F.lit(limit).cast("bigint").alias("quota"),
            F.greatest(F.lit(0).cast("bigint"), F.lit(limit) - used).alias("remaining"),
            (used.cast("double") / F.lit(float(limit)) * F.lit(100.0)).alias("used_pct"))

    return usage("chat_id", "chat", F.count(F.lit(1)), MAX_FILES_PER_CHAT).unionByName(
        usage("user_id", "user", F.sum("size_bytes"), MAX_USER_BYTES))
