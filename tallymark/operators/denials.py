"""Denial categories.

Encounter rows are read once and combined per task before the shuffle. The
cells of a code (one per state) travel with its totals, so ranking the codes and
breaking them down needs no second pass over the rows and no join back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import exprs as X
from tallymark.functions.exprs import Encounters

# Patient-responsibility and contractual codes left out, by prefix.
EXCLUDED_PREFIXES = ("CO-45", "CO45", "PR-1", "PR1", "PR-2", "PR2", "PR-3", "PR3")
TOP_CODES = 15


DENIAL_PARTS = ("visits", "n", "expected")


def is_denial(text: Column) -> Column:
    return text.isNotNull() & (text != "") & (F.lower(text) != "nan")


def denial_values(e: Encounters) -> dict[str, Column]:
    """What is counted (visits, rows) and summed (expected payment) per denial."""
    expected = e.need("expected", "denials", "No expected payment column found")
    visit = e.raw("visit_id") if "visit_id" in e.columns else F.lit(1)
    return dict(zip(DENIAL_PARTS, (visit, F.lit(1), e.number(expected))))


def denied_texts(df: DataFrame, *keys: str) -> DataFrame:
    """Denials per distinct text (and ``keys``), with code and description.

    Texts repeat a code book, so rows are combined by raw text first and only
    the distinct texts are cleaned and split. ``excluded`` marks the prefixes
    left out; callers aggregate it and filter afterwards, because a filter here
    would be pushed below the grouping and run its patterns on every row.
    """
    e = Encounters.of(df)
    text = e.raw(e.need("denial", "default", "No denial description column found")).cast("string")
    state = e.need("state", "default", "No state column found")
    e.need("expected", "denials", "No expected payment column found")
    if e.stored:
        texts = e.slice("denials").groupBy("text", *keys).agg(*[F.sum(f"_{n}").alias(n) for n in DENIAL_PARTS])
    else:
        value = denial_values(e)
        texts = (e.df.select(text.alias("text"), e.raw(state).alias("state"), *[value[n].alias(n) for n in value])
                 .filter(is_denial(F.col("text"))).groupBy("text", *keys)
                 .agg(F.count("visits").alias("visits"), F.count("n").alias("n"), F.sum("expected").alias("expected")))
    described = texts.select(X.squeeze(F.col("text")).alias("description"), "visits", "n",
                             "expected", *keys)
    coded = described.withColumn(
        "code", F.trim(F.split_part("description", F.lit(":"), F.lit(1))))
    excluded = "^(" + "|".join(re.escape(p) for p in EXCLUDED_PREFIXES) + ")"
    return coded.withColumn("excluded", F.upper("code").rlike(excluded))


def _kept(grouped: DataFrame) -> DataFrame:
    return grouped.filter(~F.col("excluded")).drop("excluded")


def denial_totals(df: DataFrame) -> DataFrame:
    """Per code: visits, expected payment and one description."""
    return _kept(denied_texts(df).groupBy("code").agg(
        F.max("excluded").alias("excluded"), F.sum("visits").alias("total_visits"),
        X.total(F.col("expected")).alias("total_expected"),
        F.min("description").alias("sample_description")))


def _most_frequent(totals: DataFrame, n: int) -> DataFrame:
    """Top-k by visits; ties go to the lower code."""
    return totals.orderBy(F.desc("total_visits"), F.asc("code")).limit(n)


def denial_top(df: DataFrame, n: int = TOP_CODES) -> DataFrame:
    return _most_frequent(denial_totals(df), n)


def denial_states(df: DataFrame) -> DataFrame:
    """States with denials, sorted; all codes count, not only the top ones."""
    states = denied_texts(df, "state").filter(F.col("state").isNotNull()).groupBy("state").agg(
        F.min("excluded").alias("excluded"))
    return _kept(states).orderBy("state")


def top_codes_with_cells(df: DataFrame, n: int = TOP_CODES) -> DataFrame:
    """The top codes, each with its cells: one (state, n, expected) per state."""
    cells = denied_texts(df, "state").groupBy("code", "state").agg(
        F.max("excluded").alias("excluded"), F.sum("visits").alias("visits"), F.sum("n").alias("n"),
        F.sum("expected").alias("expected"), F.min("description").alias("description"))
    totals = _kept(cells).groupBy("code").agg(
        F.sum("visits").alias("total_visits"), F.sum("n").alias("visit_count"),
        X.total(F.col("expected")).alias("total_expected"),
        F.min("description").alias("sample_description"),
        F.collect_list(F.struct("state", "n", "expected")).alias("cells"))
    return _most_frequent(totals, n)


def _top_cells(df: DataFrame, n: int) -> DataFrame:
    return top_codes_with_cells(df, n).select("code", F.inline("cells"))


def denial_by_state(df: DataFrame, n: int = TOP_CODES) -> DataFrame:
    """Top codes by state; pairs without denials have no row."""
    return _top_cells(df, n).filter(F.col("state").isNotNull()).select(
        "code", "state", F.col("n").alias("visit_count"),
        F.coalesce(X.to_double(F.col("expected")), F.lit(0.0)).alias("expected"))


def denial_state_totals(df: DataFrame, n: int = TOP_CODES) -> DataFrame:
    """Totals of the top codes per state. Rows without a state are left out."""
    return (_top_cells(df, n).filter(F.col("state").isNotNull()).groupBy("state")
            .agg(F.sum("n").alias("visit_count"), X.total(F.col("expected")).alias("expected")))


def denial_margins(df: DataFrame, n: int = TOP_CODES) -> DataFrame:
    """Totals per top code, per state and overall.

    Code totals and the grand total include rows without a state; state totals
    cannot.
    """
    cells = _top_cells(df, n)
    grouped = cells.groupingSets([["code"], ["state"], []], "code", "state").agg(
        F.grouping_id().alias("_id"), F.sum("n").alias("visit_count"),
        X.total(F.col("expected")).alias("expected"))
    level = (F.when(F.col("_id") == 1, "category").when(F.col("_id") == 2, "state")
             .otherwise("grand"))
    return (grouped.select(level.alias("level"), F.coalesce("code", "state").alias("label"),
                           "visit_count", "expected")
            .filter((F.col("level") != "state") | F.col("label").isNotNull())
            .filter(F.col("visit_count").isNotNull()))
