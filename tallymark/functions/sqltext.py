"""SQL text policy as column expressions, applied to whole logs at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNLIMITED_ROWS = 999_999_999

# Words no query may hold, and columns it may not name.
FORBIDDEN_WORDS = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "EXEC",
                   "EXECUTE", "GRANT", "REVOKE")
PII_COLUMNS = ("ssn", "password", "credit_card")

# A qualified join matches twice: once by its own pattern, once as a plain join.
JOIN_PATTERNS = (r"\bJOIN\b", r"\bLEFT\s+JOIN\b", r"\bRIGHT\s+JOIN\b", r"\bINNER\s+JOIN\b",
                 r"\bOUTER\s+JOIN\b", r"\bCROSS\s+JOIN\b")
CROSS_JOIN = r"\bCROSS\s+JOIN\b"
_ANY_JOIN = r"\bJOIN\b"
_QUALIFIED_JOIN = r"\b(?:LEFT|RIGHT|INNER|OUTER|CROSS)\s+JOIN\b"

# Words of an error message that make a failed query worth rewriting.
FILE_RETRY_WORDS = ("GROUP BY", "MUST APPEAR", "AGGREGATE")
DATABASE_RETRY_WORDS = (*FILE_RETRY_WORDS, "UNKNOWN COLUMN", "TABLE", "SYNTAX")


@dataclass(frozen=True)
class Policy:
    max_rows: int = 1000
    max_joins: int = 3
    pii: Sequence[str] = ()
    forbidden: Sequence[str] = FORBIDDEN_WORDS
    operations: Sequence[str] = ("SELECT",)


FILE_POLICY = Policy(max_rows=UNLIMITED_ROWS, max_joins=3, pii=PII_COLUMNS)
DATABASE_POLICY = Policy(max_rows=UNLIMITED_ROWS, max_joins=5, pii=PII_COLUMNS)


def strip(sql: Column) -> Column:
    return F.regexp_replace(sql, r"^\s+|\s+$", "")


def operation(sql: Column) -> Column:
    """First word of the statement, skipping comments."""
    bare = F.regexp_replace(sql, r"^(?:\s|--[^\n]*(?:\n|$)|/\*(?s:.*?)\*/)+", "")
    return F.upper(F.regexp_extract(bare, r"^([A-Za-z_]+|\S)", 1))


def first_hit(text: Column, words: Sequence[str]) -> Column:
    """First listed word the text holds as a whole word; null if none.

    One pattern tells most texts, which hold none, apart.
    """
    if not words:
        return F.lit(None).cast("string")
    hits = [F.when(text.rlike(rf"\b{w}\b"), F.lit(w)) for w in words]
    return F.when(text.rlike(rf"\b({'|'.join(words)})\b"), F.coalesce(*hits))


def join_count(upper_sql: Column) -> Column:
    """Matches of all ``JOIN_PATTERNS``.

    No two qualified patterns match the same join, so one alternation counts
    them all.
    """
    total = (F.regexp_count(upper_sql, F.lit(_ANY_JOIN))
             + F.regexp_count(upper_sql, F.lit(_QUALIFIED_JOIN)))
    return F.when(F.contains(upper_sql, F.lit("JOIN")), total).otherwise(F.lit(0))


def limit_value(upper_sql: Column) -> Column:
    return F.regexp_extract(upper_sql, r"LIMIT\s+(\d+)", 1).try_cast("decimal(38,0)")


def capped_sql(sql: Column, max_rows: int) -> Column:
    """Text with a row limit added, lowered, or removed if rows are unlimited.

    Any occurrence of the word LIMIT counts as a limit, even within a name.
    """
    upper = F.upper(sql)
    has_limit = F.contains(upper, F.lit("LIMIT"))
    if max_rows >= UNLIMITED_ROWS:
        removed = F.regexp_replace(F.regexp_replace(sql, r"(?i)\s*LIMIT\s+\d+\s*", " "), r"\s+$", "")
        return F.when(has_limit, removed).otherwise(sql)
    bare = F.regexp_replace(F.regexp_replace(sql, ";+$", ""), r"\s+$", "")
    lowered = F.regexp_replace(sql, r"(?i)LIMIT\s+\d+", f"LIMIT {max_rows}")
    return (F.when(~has_limit, F.concat(bare, F.lit(f" LIMIT {max_rows}")))
            .when(limit_value(upper) > max_rows, lowered).otherwise(sql))


def tables(sql: Column) -> Column:
    """Distinct table names listed after FROM, sorted; joined tables not included."""
    one = r"[A-Za-z_`\"][\w.`\"]*(?:\s+(?:AS\s+)?(?!(?:WHERE|JOIN|LEFT|RIGHT|INNER|OUTER|CROSS|FULL|ON|GROUP|ORDER|LIMIT|HAVING|UNION)\b)\w+)?"
    lists = F.regexp_extract_all(sql, F.lit(rf"(?i)\bFROM\s+({one}(?:\s*,\s*{one})*)"), F.lit(1))
    items = F.flatten(F.transform(lists, lambda t: F.split(t, r"\s*,\s*")))
    named = F.transform(items, lambda t: F.regexp_replace(
        F.element_at(F.split(F.element_at(F.split(t, r"\s+"), 1), r"\."), -1), "[`\"]", ""))
    return F.array_sort(F.array_distinct(named))


def verdict(sql: Column, policy: Policy, *, operation: Column, word: Column, cross: Column,
            joins: Column, pii: Column) -> Column:
    """Why the statement is refused, given its findings; null if it may run."""
    allowed = ", ".join(policy.operations)
    return (
        F.when(F.coalesce(sql, F.lit("")) == "", F.lit("Empty SQL query"))
        .when(~operation.isin(*policy.operations), F.concat(
            F.lit("Operation '"), operation,
            F.lit(f"' not allowed. Only {allowed} operations are permitted.")))
        .when(word.isNotNull(), F.concat(F.lit("Forbidden keyword '"), word, F.lit("' detected")))
        .when(cross, F.lit("CROSS JOIN is not allowed (potential cartesian product)"))
        .when(joins > policy.max_joins, F.concat(
            F.lit("Too many JOINs ("), joins.cast("string"),
            F.lit(f"). Maximum allowed: {policy.max_joins}")))
        .when(pii.isNotNull(), F.concat(F.lit("Query references PII column '"), pii,
                                        F.lit("' which is not allowed"))))


def retry_word(error: Column, words: Sequence[str]) -> Column:
    """First listed phrase an error message holds, ignoring case."""
    upper = F.upper(error)
    return F.coalesce(*[F.when(F.contains(upper, F.lit(w)), F.lit(w)) for w in words],
                      F.lit(None).cast("string"))
