"""Column expressions shared by the metrics and reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import names
from tallymark.functions.roles import resolve

# Codes and types left out of the filtered sums.
EXCLUDED_STATUS = 12
EXCLUDED_CPT = ("00001", "00002", "00003", "90221", "90222")
EXCLUDED_TRANSACTION_TYPES = ("9", "10")

# Status vocabularies.
BILLED = ("claim created",)
UNBILLED = (
    "on hold", "issues pending", "credentialing hold", "pending auth", "client requested hold",
    "adjustment approval pending from client", "eligibility failed", "alert")
SUBMITTED_WORDS = ("claim created", "submitted", "billed")

# Text dates other than ISO that are accepted, month first.
TEXT_DATE_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yy")

DAY_MICROS = 86_400_000_000


class MissingColumns(ValueError):
    """A report cannot be built because the table lacks a needed column."""


# --- arithmetic -----------------------------------------------------------------


def to_double(c: Column) -> Column:
    return c.cast("double")


def safe_divide(n: Column, d: Column, default: float = 0.0) -> Column:
    """``n / d`` in double; ``default`` where d is zero or either side is null."""
    return F.coalesce(F.try_divide(to_double(n), to_double(d)), F.lit(float(default)))


def percent(n: Column, d: Column) -> Column:
    return safe_divide(n, d) * F.lit(100.0)


def total(c: Column, where: Column | None = None) -> Column:
    """Sum as double, 0.0 over no rows. Decimals stay exact until the final cast."""
    summed = F.sum(c if where is None else F.when(where, c))
    return F.coalesce(to_double(summed), F.lit(0.0))


def positive_total(c: Column, where: Column | None = None) -> Column:
    """Sum of the positive values; ``c`` is evaluated once per row."""
    return total(F.greatest(c, F.lit(0)), where)


def count_where(where: Column) -> Column:
    return F.count(F.when(where, F.lit(1)))


# --- time -----------------------------------------------------------------------


def as_of_time(as_of: dt.date | dt.datetime | str | Column | None) -> Column:
    """The moment reports call "now"; the clock only if the caller gives none."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, dt.date):
        as_of = as_of.isoformat()
    return F.lit(as_of).cast("timestamp_ntz")


def day_of(ts: Column) -> Column:
    """Midnight of the same day."""
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def midnight(date: Column) -> Column:
    return date.cast("timestamp_ntz")


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, floored, so less than a day ahead is -1."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor((micros - F.pmod(micros, F.lit(DAY_MICROS))) / F.lit(DAY_MICROS)).cast("bigint")


def shift_days(ts: Column, days: int | Column) -> Column:
    """Move by whole days, keeping the time of day."""
    days = F.lit(days) if isinstance(days, int) else days
    return ts + F.make_dt_interval(days.cast("int"))


def month_start(ts: Column) -> Column:
    """First of the month as a date."""
    return F.trunc(ts.cast("date"), "month")


def quarter_start(year: Column, quarter: Column) -> Column:
    return F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1))


def tuesday_week(date: Column) -> Column:
    """Number of the Tuesday-to-Monday week within its month.

    Week 1 runs from the 1st to the first Monday.
    """
    first = F.trunc(date, "month")
    first_monday = F.next_day(F.date_sub(first, 1), "Mon")
    return (F.lit(1) + F.floor((F.datediff(date, first_monday) + 6) / 7)).cast("int")


def monday_of(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("date")


def week_label(monday: Column) -> Column:
    """Such as ``Jul 3rd Week``; the ordinal counts weeks by the Monday's day."""
    nth = (F.floor((F.dayofmonth(monday) - 1) / 7) + 1).cast("int")
    suffix = F.when(nth == 1, "st").when(nth == 2, "nd").when(nth == 3, "rd").otherwise("th")
    return F.concat(F.date_format(monday, "MMM"), F.lit(" "), nth.cast("string"), suffix,
                    F.lit(" Week"))


def anchors(df: DataFrame, *values: Column) -> list[Column]:
    """Aggregates of ``df`` as scalar subqueries, to filter another scan by.

    Each bound is a subquery of its own rather than an expression over one, so
    that it is a plain value by the time the scan is planned and is not worked
    out again for every row. They share one scan: their partial aggregates are
    the same.
    """
    return [df.agg(v.alias("anchor")).scalar() for v in values]


# --- text -----------------------------------------------------------------------


def squeeze(c: Column) -> Column:
    """Collapse runs of white space and trim."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal_status(c: Column) -> Column:
    return F.lower(F.btrim(c.cast("string"), F.lit(" \t\r\n")))


def contains_any(c: Column, words: Iterable[str], strict: bool = False) -> Column:
    """Whether lower-cased text contains any word; null text contains none.

    ``strict`` asks for whole words, so "unbilled" no longer counts as "billed".
    """
    text = F.lower(c.cast("string"))
    if strict:
        found = text.rlike(rf"\b({'|'.join(words)})\b")
    else:
        found = reduce(or_, [F.contains(text, F.lit(w)) for w in words])
    return F.coalesce(found, F.lit(False))


# --- encounter table ------------------------------------------------------------


class Encounters:
    """An encounter table with its columns named and typed for the metrics.

    Holds schema knowledge only; building one starts no job. Reports read the
    slice they name: here every slice is the table, in a rollup it is stored sums.
    """

    stored = False

    def __init__(self, df: DataFrame):
        self.df = names.rename(df, names.metric_name)
        self.types = {f.name: f.dataType for f in self.df.schema.fields}
        self.columns = list(self.types)

    @classmethod
    def of(cls, df: DataFrame | Encounters) -> Encounters:
        return df if isinstance(df, cls) else cls(df)

    def find(self, role: str, context: str = "default") -> str | None:
        return resolve(self.columns, role, context)

    def need(self, role: str, context: str, message: str) -> str:
        found = self.find(role, context)
        if found is None:
            raise MissingColumns(message)
        return found

    def slice(self, name: str) -> DataFrame:
        return self.df

    def raw(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def number(self, name: str) -> Column:
        """Column as a number; NaN and unreadable text become null."""
        c, kind = self.raw(name), self.types[name]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c)
        if isinstance(kind, T.BooleanType):
            return c.cast("int")
        if isinstance(kind, T.NumericType):
            return c
        number = c.cast("string").try_cast("double")
        return F.when(~F.isnan(number), number)

    def time(self, name: str) -> Column:
        """Column as a timestamp without zone; unreadable text becomes null."""
        c, kind = self.raw(name), self.types[name]
        if isinstance(kind, T.TimestampNTZType):
            return c
        if isinstance(kind, (T.DateType, T.TimestampType)):
            return c.cast("timestamp_ntz")
        text = c.cast("string")
        readings = [text.try_cast("timestamp_ntz")]
        readings += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")
                     for f in TEXT_DATE_FORMATS]
        return F.coalesce(*readings)

    def status(self, name: str) -> Column:
        return normal_status(self.raw(name))

    def business_rows(self, transactions: bool = False) -> Column:
        """Rows kept by the filtered sums. Nulls are kept: they match no exclusion."""
        keep = F.lit(True)
        status = self.find("status", "filtered")
        if status:
            if isinstance(self.types[status], T.NumericType):
                keep = ~self.raw(status).eqNullSafe(F.lit(EXCLUDED_STATUS))
            else:
                keep = ~self.raw(status).cast("string").eqNullSafe(F.lit(str(EXCLUDED_STATUS)))
        cpt = self.find("cpt", "filtered")
        if cpt:
            keep = keep & outside(self.raw(cpt).cast("string"), EXCLUDED_CPT)
        kind = self.find("transaction_type", "filtered") if transactions else None
        if kind:
            if isinstance(self.types[kind], T.NumericType):
                keep = keep & outside(self.raw(kind), [int(t) for t in EXCLUDED_TRANSACTION_TYPES])
            else:
                keep = keep & outside(self.raw(kind).cast("string"), EXCLUDED_TRANSACTION_TYPES)
        return keep


def outside(c: Column, values: Sequence) -> Column:
    """``NOT IN`` that keeps nulls."""
    return F.coalesce(~c.isin(*values), F.lit(True))
