"""Text rules as column expressions: file names, sheet names, questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upload formats and words a sheet may not be called.
SUPPORTED_EXTENSIONS = (".xlsb", ".xlsx", ".xls", ".csv", ".tsv", ".parquet")
DANGEROUS_EXTENSIONS = (".exe", ".dll", ".bat", ".cmd", ".sh", ".ps1", ".vbs", ".js", ".jar",
                        ".app", ".dmg", ".pkg", ".deb", ".rpm")
SQL_WORDS = ("SELECT", "FROM", "WHERE", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER",
             "TABLE", "INDEX", "VIEW")
REPORT_PHRASES = ("/weeklyreport", "weekly report", "weekly kpi", "kpi report", "weekly metrics",
                  "weekly summary", "performance report")
COMPANY_WORDS = ("for", "company", "client")
DEFAULT_COMPANY = "Company"

MAX_NAME_LENGTH = 100


def two_decimals(c: Column) -> Column:
    """Two decimals, ties to even, without thousands separators."""
    return F.translate(F.format_number(c, 2), ",", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for dot files and names without one."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def sanitize_filename(path: Column) -> Column:
    """A name safe to store: word characters, dots and dashes, 100 at most."""
    name = base_name(path)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    stem = F.left(name, F.length(name) - F.length(suffix))
    safe = F.regexp_replace(stem, r"(?U)[^\w\s\-.]", "_")
    safe = F.btrim(F.regexp_replace(safe, r"(?U)[\s_]+", "_"), F.lit("_."))
    safe = F.left(safe, F.lit(MAX_NAME_LENGTH))
    return F.concat(F.when(safe == "", F.lit("upload")).otherwise(safe), F.lower(suffix))


def sheet_name_error(name: Column) -> Column:
    """Why a sheet name is refused; null if it is fine."""
    quoted = F.concat(F.lit("Sheet name '"), name, F.lit("'"))
    return (F.when(F.coalesce(F.trim(F.regexp_replace(name, r"\s", " ")), F.lit("")) == "",
                   F.lit("Sheet has empty name"))
            .when(F.upper(name).isin(*SQL_WORDS), F.concat(quoted, F.lit(" is a SQL keyword")))
            .when(~name.rlike(r"^[a-zA-Z0-9_\s\-]+$"),
                  F.concat(quoted, F.lit(" contains invalid characters"))))


def title_case(c: Column) -> Column:
    """Upper case at the start of every run of letters, lower case elsewhere."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def is_report_request(question: Column) -> Column:
    lower = F.lower(question)
    asked = F.lit(False)
    for phrase in REPORT_PHRASES:
        asked = asked | F.contains(lower, F.lit(phrase))
    return F.coalesce(asked, F.lit(False))


def company(question: Column) -> Column:
    """Company a question names.

    What follows ``--``, or the word after "for", "company" or "client"; the
    later of these keywords wins.
    """
    lower = F.lower(question)
    found = []
    for word in reversed(COMPANY_WORDS):
        after = F.regexp_extract(lower, rf"(?:^|\s){word}\s+(\S+)", 1)
        found.append(F.nullif(title_case(F.btrim(after, F.lit(",.!?"))), F.lit("")))
    dashed = F.when(F.contains(lower, F.lit("--")),
                    title_case(F.trim(F.split_part(lower, F.lit("--"), F.lit(2)))))
    return F.coalesce(*found, dashed, F.lit(DEFAULT_COMPANY))


def without_fence(reply: Column) -> Column:
    """SQL text without a surrounding code fence."""
    return F.trim(F.regexp_replace(reply, r"```(?:sql)?\s*", ""))
