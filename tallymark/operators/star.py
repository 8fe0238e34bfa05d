"""Billing star schema: joins, filters and formulas of the operational tables.

Filters here are plain SQL predicates and drop nulls, unlike the encounter
filters. Measures are summed per join key before each join, so the rows that
cross a shuffle are one per key however many lines or payments a key has. Sums per
line are staged in small tasks: they hold every line of a task in memory.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import exprs as X
from tallymark.session import stage_table

Star = Mapping[str, DataFrame]

EXCLUDED_TRANSACTION_TYPES = (9, 10)


def alive(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def kept_visits(star: Star) -> DataFrame:
    return alive(star["patient_visit"]).filter(F.col("status") != X.EXCLUDED_STATUS)


def kept_codes(star: Star) -> DataFrame:
    return alive(star["cpt_codes"]).filter(~F.col("cpt_code").isin(*X.EXCLUDED_CPT))


def kept_payments(star: Star) -> DataFrame:
    return alive(star["payment"]).filter(
        ~F.col("transaction_type").isin(*EXCLUDED_TRANSACTION_TYPES))


def date_preset(date: Column, preset: str, as_of=None) -> Column:
    """``month``, ``quarter``, ``year`` or ``week`` relative to ``as_of``.

    Month runs to its last day; week is today and the seven days before.
    Quarter and year are written as ranges so that they reach the scan.
    """
    today = X.as_of_time(as_of).cast("date")
    day = date.cast("date")
    if preset == "month":
        return (day >= F.trunc(today, "month")) & (day <= F.last_day(today))
    if preset == "quarter":
        start = F.trunc(today, "quarter")
        return (day >= start) & (day < F.add_months(start, 3))
    if preset == "year":
        start = F.trunc(today, "year")
        return (day >= start) & (day < F.add_months(start, 12))
    if preset == "week":
        return (day >= F.date_sub(today, 7)) & (day <= today)
    raise ValueError(f"unknown date preset: {preset}")


def _lines_with_codes(star: Star) -> DataFrame:
    lines = alive(star["patient_visit_cpt"]).select(
        F.col("id").alias("line_id"), "visit_id", "cpt_id", "unit", "cpt_amount")
    codes = kept_codes(star).select(F.col("id").alias("code_id"))
    return lines.join(codes, F.col("cpt_id") == F.col("code_id"))


def _charge() -> Column:
    return F.coalesce(F.col("unit"), F.lit(0)) * F.coalesce(F.col("cpt_amount"), F.lit(0))


def charges_per_visit(star: Star) -> DataFrame:
    """visit -> line -> code, with charges and line counts summed per visit."""
    per_visit = _lines_with_codes(star).groupBy("visit_id").agg(
        F.sum(_charge()).alias("charges"), F.count(F.lit(1)).alias("line_count"))
    visits = kept_visits(star).select("id", "visit_date")
    return visits.join(per_visit, F.col("id") == F.col("visit_id"))


def charges_by_year(star: Star) -> DataFrame:
    return charges_per_visit(star).groupBy(F.year("visit_date").alias("year")).agg(
        X.total(F.col("charges")).alias("charges"), F.sum("line_count").alias("line_count"))


def charges_in(star: Star, preset: str, as_of=None) -> DataFrame:
    """Visits, lines and charges of a date preset.

    The visits of the period meet the lines first, so lines of other days are
    neither summed nor joined to codes.
    """
    visits = kept_visits(star).filter(date_preset(F.col("visit_date"), preset, as_of)).select("id")
    lines = alive(star["patient_visit_cpt"]).select("visit_id", "cpt_id", "unit", "cpt_amount")
    codes = kept_codes(star).select(F.col("id").alias("code_id"))
    rows = (lines.join(visits, F.col("visit_id") == F.col("id"))
            .join(codes, F.col("cpt_id") == F.col("code_id")))
    per_visit = rows.groupBy("visit_id").agg(F.sum(_charge()).alias("charges"),
                                             F.count(F.lit(1)).alias("line_count"))
    return per_visit.agg(F.count(F.lit(1)).alias("visit_count"),
                         F.coalesce(F.sum("line_count"), F.lit(0)).alias("line_count"),
                         X.total(F.col("charges")).alias("charges"))


def payments_by_year(star: Star) -> DataFrame:
    """payment -> line -> visit -> code, payments summed per line, then per visit."""
    per_line = kept_payments(star).groupBy("encounter_id").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("payment_count"))
    lines = _lines_with_codes(star).select("line_id", "visit_id")
    per_visit = (lines.join(per_line, F.col("line_id") == F.col("encounter_id"))
                 .groupBy("visit_id").agg(F.sum("amount").alias("amount"),
                                          F.sum("payment_count").alias("payment_count")))
    visits = kept_visits(star).select("id", "visit_date")
    by_year = (visits.join(per_visit, F.col("id") == F.col("visit_id"))
               .groupBy(F.year("visit_date").alias("year"))
               .agg(X.total(F.col("amount")).alias("payments"),
                    F.sum("payment_count").alias("payment_count")))
    return stage_table(by_year, "payments", small_tasks=True)


def lines_left_payments(star: Star) -> DataFrame:
    """All live lines per year, with the payments some of them have."""
    per_line = kept_payments(star).groupBy("encounter_id").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("payment_count"))
    lines = alive(star["patient_visit_cpt"]).select(F.col("id").alias("line_id"), "visit_id")
    joined = lines.join(per_line, F.col("line_id") == F.col("encounter_id"), "left")
    per_visit = joined.groupBy("visit_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.count("encounter_id").alias("paid_lines"),
        F.sum("amount").alias("amount"))
    visits = kept_visits(star).select("id", "visit_date")
    by_year = (visits.join(per_visit, F.col("id") == F.col("visit_id"))
               .groupBy(F.year("visit_date").alias("year"))
               .agg(F.sum("line_count").alias("line_count"),
                    F.sum("paid_lines").alias("paid_lines"),
                    X.total(F.col("amount")).alias("payments")))
    return stage_table(by_year, "left_payments", small_tasks=True)


def visits_by_status(star: Star) -> DataFrame:
    """Live visits per status name. Visits are counted first, then named."""
    counts = alive(star["patient_visit"]).groupBy("status").agg(
        F.count(F.lit(1)).alias("visit_count"))
    names = star["visit_status"].select(F.col("id").alias("status_id"),
                                        F.col("name").alias("status_name"))
    return (counts.join(names, F.col("status") == F.col("status_id"))
            .groupBy("status_name").agg(F.sum("visit_count").alias("visit_count")))
