"""KPIs as conditional aggregates.

A metric is a set of named sums plus an expression over them. Any number of
metrics evaluated together share one scan and one aggregation, with partial sums
on the map side; the same metric works for the whole table, per period, and over
sums stored earlier (``plans/rollup.py``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import exprs as X
from tallymark.functions import parts as S
from tallymark.functions.exprs import Encounters
from tallymark.functions.parts import Part

DENIAL_RESOLUTION_PCT = 85.0  # fixed value: the rate is a placeholder constant
DEFAULT_PERIOD_DAYS = 365

# Status lists of the AR summary.
SUMMARY_BILLED = ("claim created", "approved", "reviewed", "rejected")
SUMMARY_UNBILLED = ("on hold", "issues pending", "credentialing hold", "pending auth")
AGING_31_60 = (31, 60)
AGING_60_PLUS = (60, 90)  # the bucket called "60+" ends at 90; day 60 is in both


@dataclass(frozen=True)
class Metric:
    """``parts`` are sums over rows; a plain column among them aggregates the date alone."""

    name: str
    parts: Mapping[str, Part | Column] = field(default_factory=dict)
    result: Column | None = None

    def value(self) -> Column:
        return self.result if self.result is not None else F.col(next(iter(self.parts)))


def simple(name: str, aggregate: Part | Column) -> Metric:
    return Metric(name, {f"_{name}": aggregate})


def constant(name: str, value: float) -> Metric:
    return Metric(name, {}, F.lit(value))


def evaluate(df: DataFrame, metrics: Iterable[Metric], keys: Sequence[str] = (),
             stored: bool = False) -> DataFrame:
    """One aggregation for all metrics; one row, or one per key.

    ``stored`` says that the rows of ``df`` hold sums of the parts, under their names.
    """
    metrics = list(metrics)
    parts: dict[str, Part | Column] = {}
    for metric in metrics:
        parts.update(metric.parts)
    if not parts:
        parts["_rows"] = F.count(F.lit(1))
    grouped = df.groupBy(*keys) if keys else df

    def aggregate(name: str, part: Part | Column) -> Column:
        if not isinstance(part, Part):
            return part
        return part.merged(name) if stored else part.direct()

    summed = grouped.agg(*[aggregate(n, c).alias(n) for n, c in parts.items()])
    return summed.select(*keys, *[m.value().alias(m.name) for m in metrics])


# --- sums ------------------------------------------------------------------------


def total_visits(e: Encounters) -> Metric:
    counter = e.find("visits", "total")
    if counter:
        return simple("visits", S.whole_amount(e.number(counter)))
    if "visit_status" in e.columns:
        return simple("visits", S.tally(e.raw("visit_status").isNotNull()))
    return row_count()


def row_count(name: str = "visits") -> Metric:
    return simple(name, S.tally())


def total_charges(e: Encounters, context: str = "total") -> Metric:
    column = e.find("charge", context)
    return simple("charges", S.positive(e.number(column))) if column else constant("charges", 0.0)


def total_payments(e: Encounters, context: str = "total") -> Metric:
    column = e.find("payment", context)
    return simple("payments", S.amount(e.number(column))) if column else constant("payments", 0.0)


def column_total(e: Encounters, column: str, name: str) -> Metric:
    return simple(name, S.amount(e.number(column))) if column in e.columns else constant(name, 0.0)


def balance(e: Encounters) -> Metric:
    column = e.find("balance", "total")
    return simple("balance", S.amount(e.number(column))) if column else constant("balance", 0.0)


def filtered_charges(e: Encounters, dated: Column | None = None) -> Metric:
    """Positive charges outside the excluded status and CPT codes."""
    keep = e.business_rows()
    column = e.find("charge", "filtered")
    if column:
        return simple("filtered_charges", S.positive(e.number(column), keep, dated))
    unit, amount = e.find("unit", "filtered"), e.find("amount", "filtered")
    if unit and amount:
        # Narrow integers would overflow in their own type.
        units = e.number(unit)
        if isinstance(e.types[unit], T.IntegralType) and isinstance(e.types[amount], T.IntegralType):
            units = units.cast("bigint")
        product = F.coalesce(units, F.lit(0)) * F.coalesce(e.number(amount), F.lit(0))
        return simple("filtered_charges", S.positive(product, keep, dated))
    return _plain_charges(e, dated, "filtered_charges")


def _plain_charges(e: Encounters, dated: Column | None, name: str) -> Metric:
    column = e.find("charge", "total")
    if not column:
        return constant(name, 0.0)
    return simple(name, S.positive(e.number(column), dated=dated))


def filtered_payments(e: Encounters, dated: Column | None = None,
                      where: Column | None = None) -> Metric:
    """Payments outside the excluded transaction types, status and CPT codes."""
    keep = e.business_rows(transactions=True)
    column = e.find("payment", "filtered")
    if column:
        keep = keep if where is None else keep & where
        return simple("filtered_payments", S.amount(e.number(column), keep, dated))
    column = e.find("payment", "total")
    if column:
        return simple("filtered_payments", S.amount(e.number(column), where, dated))
    return constant("filtered_payments", 0.0)


def expected_payments(e: Encounters) -> Metric:
    """Expected payments; else charges less contractuals; else charges."""
    column = e.find("expected", "total")
    if column:
        return simple("expected", S.amount(e.number(column)))
    contractual = e.find("contractual", "total")
    charges = total_charges(e)
    if contractual:
        parts = {**charges.parts, "_contractual": S.amount(e.number(contractual))}
        return Metric("expected", parts, charges.value() - F.col("_contractual"))
    return Metric("expected", charges.parts, charges.value())


def expected_payments_filtered(e: Encounters) -> Metric:
    keep = e.business_rows()
    column = e.find("expected", "filtered")
    if column:
        return simple("expected_filtered", S.amount(e.number(column), keep))
    contractual = e.find("contractual", "total")
    charges = filtered_charges(e)
    if contractual:
        parts = {**charges.parts, "_contractual_kept": S.amount(e.number(contractual), keep)}
        return Metric("expected_filtered", parts, charges.value() - F.col("_contractual_kept"))
    return Metric("expected_filtered", charges.parts, charges.value())


# --- rates -----------------------------------------------------------------------


def charges_submitted_pct(e: Encounters, strict: bool = False) -> Metric:
    """Share of positive charges whose status says submitted."""
    name = "charges_submitted_pct"
    status, charge = e.find("status", "submitted"), e.find("charge", "submitted")
    submitted = X.contains_any(e.raw(status), X.SUBMITTED_WORDS, strict) if status else None
    if status and charge:
        amount = e.number(charge)
        parts = {"_submitted": S.positive(amount, submitted),
                 "_submittable": S.positive(amount)}
    elif "charges_submitted" in e.columns:
        charges = total_charges(e)
        parts = {"_submitted": S.amount(e.number("charges_submitted")), **charges.parts}
        return Metric(name, parts, X.percent(F.col("_submitted"), charges.value()))
    elif status:
        parts = {"_submitted": S.tally(submitted), "_submittable": S.tally()}
    else:
        return constant(name, 100.0)
    return Metric(name, parts, X.percent(F.col("_submitted"), F.col("_submittable")))


def charges_submitted_percentage(e: Encounters, charge: str, status: str,
                                 statuses: Sequence[str]) -> Metric:
    """Like ``charges_submitted_pct`` for named columns and exact statuses."""
    name = "charges_submitted_exact_pct"
    if charge not in e.columns or status not in e.columns:
        return constant(name, 0.0)
    listed = F.lower(e.raw(status).cast("string")).isin(*[s.lower() for s in statuses])
    amount = e.number(charge)
    parts = {"_listed": S.positive(amount, listed), "_listable": S.positive(amount)}
    return Metric(name, parts, X.percent(F.col("_listed"), F.col("_listable")))


def gross_collection_rate(e: Encounters) -> Metric:
    payments, charges = total_payments(e), total_charges(e)
    return Metric("gross_collection_rate_pct", {**payments.parts, **charges.parts},
                  X.percent(payments.value(), charges.value()))


def net_collection_rate(e: Encounters) -> Metric:
    payments, expected = total_payments(e), expected_payments(e)
    return Metric("net_collection_rate_pct", {**payments.parts, **expected.parts},
                  X.percent(payments.value(), expected.value()))


def denial_resolution_rate() -> Metric:
    return Metric("denial_resolution_rate_pct", {}, F.lit(DENIAL_RESOLUTION_PCT))


def rounded(metric: Metric, digits: int = 2) -> Metric:
    return Metric(metric.name, metric.parts, F.round(metric.value(), digits))


# --- accounts receivable -----------------------------------------------------------


def ending_ar(e: Encounters) -> Metric:
    """Sum of balances; a sum of exactly zero falls back to charges less payments."""
    owed, charges, payments = balance(e), total_charges(e), total_payments(e)
    parts = {**owed.parts, **charges.parts, **payments.parts}
    value = F.when(owed.value() == 0, charges.value() - payments.value()).otherwise(owed.value())
    return Metric("ending_ar", parts, value)


def ar_days(ar: Column, charges: Column, period: Column) -> Column:
    """AR over average daily charges, rounded up; 0 without charges or period."""
    return F.coalesce(F.ceil(F.try_divide(ar, F.try_divide(charges, X.to_double(period)))),
                      F.lit(0)).cast("bigint")


def days_in_ar(e: Encounters, period_days: int | None = None) -> Metric:
    """Days in AR over a given period, or over the span of service dates."""
    ar, charges = ending_ar(e), total_charges(e)
    parts = {**ar.parts, **charges.parts}
    date = e.find("service_date")
    if period_days is not None:
        period = F.lit(period_days)
    elif date:
        parts |= {"_first": F.min(e.time(date)), "_last": F.max(e.time(date))}
        period = F.greatest(X.elapsed_days(F.col("_first"), F.col("_last")) + 1, F.lit(1))
    else:
        period = F.lit(DEFAULT_PERIOD_DAYS)
    # greatest() skips nulls, so a column without a valid date is caught here
    if period_days is None and date:
        period = F.when(F.col("_first").isNotNull(), period)
    return Metric("days_in_ar", parts, ar_days(ar.value(), charges.value(), period))


def weekly_period(e: Encounters, as_of, context: str = "default") -> tuple[dict, Column]:
    """365 days, or the year to date if every service date lies in this year."""
    date = e.find("service_date", context)
    if not date:
        return {}, F.lit(DEFAULT_PERIOD_DAYS)
    now = X.as_of_time(as_of)
    parts = {"_first": F.min(e.time(date)), "_last": F.max(e.time(date))}
    this_year = (F.year("_first") == F.year(now)) & (F.year("_last") == F.year(now))
    return parts, F.when(this_year, F.dayofyear(now)).otherwise(F.lit(DEFAULT_PERIOD_DAYS))


def days_in_ar_weekly(e: Encounters, as_of) -> Metric:
    ar, charges = ending_ar(e), total_charges(e)
    parts, period = weekly_period(e, as_of)
    return Metric("days_in_ar", {**ar.parts, **charges.parts, **parts},
                  ar_days(ar.value(), charges.value(), period))


def yearly_period(year: Column, as_of) -> Column:
    """365 days also in leap years; the current year counts to date."""
    now = X.as_of_time(as_of)
    return F.when(year == F.year(now), F.dayofyear(now)).otherwise(F.lit(DEFAULT_PERIOD_DAYS))


def quarterly_period(year: Column, quarter: Column, as_of) -> Column:
    """Days of the quarter; the current quarter counts to date."""
    now = X.as_of_time(as_of)
    start = X.quarter_start(year, quarter)
    current = (year == F.year(now)) & (quarter == F.quarter(now))
    return F.when(current, F.datediff(now.cast("date"), start) + 1).otherwise(
        F.datediff(F.add_months(start, 3), start))


def days_in_ar_for(e: Encounters, period: Column) -> Metric:
    ar, charges = ending_ar(e), total_charges(e)
    return Metric("days_in_ar", {**ar.parts, **charges.parts},
                  ar_days(ar.value(), charges.value(), period))


def billed_ar(e: Encounters) -> Metric:
    """Balance of billed claims; else the whole balance; else charges less payments."""
    status, owed = e.find("status", "billed"), e.find("balance", "total")
    if status and owed:
        return simple("billed_ar", S.amount(e.number(owed), e.status(status).isin(*X.BILLED)))
    if owed:
        return simple("billed_ar", S.amount(e.number(owed)))
    charges, payments = total_charges(e), total_payments(e)
    return Metric("billed_ar", {**charges.parts, **payments.parts},
                  charges.value() - payments.value())


def unbilled_ar(e: Encounters) -> Metric:
    """Balance of eight unbilled statuses; else what charges exceed billed AR by."""
    status, owed = e.find("status", "billed"), e.find("balance", "total")
    if status and owed:
        return simple("unbilled_ar", S.amount(e.number(owed), e.status(status).isin(*X.UNBILLED)))
    charges, billed = total_charges(e), billed_ar(e)
    return Metric("unbilled_ar", {**charges.parts, **billed.parts},
                  F.greatest(F.lit(0.0), charges.value() - billed.value()))


def billed_ar_pct(e: Encounters) -> Metric:
    billed, unbilled = billed_ar(e), unbilled_ar(e)
    return Metric("billed_ar_pct", {**billed.parts, **unbilled.parts},
                  X.percent(billed.value(), billed.value() + unbilled.value()))


def unbilled_ar_pct(e: Encounters) -> Metric:
    billed, unbilled = billed_ar(e), unbilled_ar(e)
    return Metric("unbilled_ar_pct", {**billed.parts, **unbilled.parts},
                  X.percent(unbilled.value(), billed.value() + unbilled.value()))


def status_ar(e: Encounters, owed: str, status: str, statuses: Sequence[str], name: str) -> Metric:
    """Balance of rows whose lower-cased status is listed."""
    if owed not in e.columns or status not in e.columns:
        return constant(name, 0.0)
    listed = F.lower(e.raw(status).cast("string")).isin(*[s.lower() for s in statuses])
    return simple(name, S.amount(e.number(owed), listed))


def _bucket(e: Encounters, date: str, owed: str, days: tuple[int, int], as_of) -> Part:
    age = X.elapsed_days(e.time(date), X.as_of_time(as_of))
    return S.amount(e.number(owed), dated=age.between(*days))


def _aged(e: Encounters, role: str, days: tuple[int, int], name: str, as_of) -> Metric:
    ready = e.find(role)
    if ready:
        return simple(name, S.amount(e.number(ready)))
    date, owed = e.find("bill_date"), e.find("balance", "total")
    if not (date and owed):
        return constant(name, 0.0)
    return simple(name, _bucket(e, date, owed, days, as_of))


def ar_31_60(e: Encounters, as_of) -> Metric:
    return _aged(e, "bucket_31_60", AGING_31_60, "ar_31_60_days", as_of)


def ar_60_plus(e: Encounters, as_of) -> Metric:
    return _aged(e, "bucket_60_plus", AGING_60_PLUS, "ar_60_plus_days", as_of)


def ar_aging(e: Encounters, date: str, owed: str, buckets: Sequence[tuple[int, int]],
             as_of) -> list[Metric]:
    """Balance per age bucket; both ends count, and buckets may overlap."""
    if date not in e.columns or owed not in e.columns:
        return [constant(f"ar_{lo}_{hi}", 0.0) for lo, hi in buckets]
    return [simple(f"ar_{lo}_{hi}", _bucket(e, date, owed, (lo, hi), as_of)) for lo, hi in buckets]


def aged_ar(e: Encounters, lo: int, hi: int, as_of) -> Metric:
    """One age bucket by the first date and balance column found."""
    date, owed = e.find("service_date", "aged"), e.find("balance", "aged")
    if not (date and owed):
        return constant("aged_ar", 0.0)
    return simple("aged_ar", _bucket(e, date, owed, (lo, hi), as_of))


# --- range and forecast -----------------------------------------------------------


def date_range(e: Encounters, date: str) -> list[Metric]:
    """First and last date and the days they span; nulls and 0 without dates."""
    if date not in e.columns:
        return [Metric("min_date", {}, F.lit(None).cast("timestamp_ntz")),
                Metric("max_date", {}, F.lit(None).cast("timestamp_ntz")),
                Metric("days", {}, F.lit(0).cast("bigint"))]
    parts = {"_first": F.min(e.time(date)), "_last": F.max(e.time(date))}
    first, last = F.col("_first"), F.col("_last")
    return [Metric("min_date", parts, first), Metric("max_date", parts, last),
            Metric("days", parts, F.coalesce(X.elapsed_days(first, last) + 1,
                                             F.lit(0)).cast("bigint"))]


def forecast(e: Encounters, metric: str, date: str, days: int) -> Metric:
    """Daily average of history times ``days``.

    ``visits`` counts rows but, as a column must exist to be forecast, gives 0
    without one; ``rows`` counts rows of any table.
    """
    if metric not in e.columns and metric != "rows":
        return constant("forecast", 0.0)
    rows = F.count(F.lit(1))
    amount = rows if metric in ("visits", "rows") else X.positive_total(e.number(metric))
    parts = {"_history": amount}
    if date in e.columns:
        parts |= {"_first": F.min(e.time(date)), "_last": F.max(e.time(date))}
        period = X.elapsed_days(F.col("_first"), F.col("_last")) + 1
    else:
        parts |= {"_rows": rows}
        period = F.col("_rows")
    return Metric("forecast", parts, X.safe_divide(F.col("_history"), period) * F.lit(float(days)))


# --- interactive tools --------------------------------------------------------------


def current_month(e: Encounters, date_filter: str | None) -> DataFrame:
    """Rows from the first of the latest month on.

    Any other filter name only drops rows without a valid date. The latest date
    is a scalar subquery, so the bound reaches the scan.
    """
    rows = e.slice("tool")
    date = e.find("service_date", "tool_filter") if date_filter else None
    if not date:
        return rows
    dated = rows.filter(e.time(date).isNotNull())
    if date_filter == "current_month":
        newest = F.max(e.time(date))
        start, latest = X.anchors(rows, latest_month_start(newest), newest)
        dated = dated.filter((e.time(date) >= start) & (e.time(date) <= latest))
    return dated


def latest_month_start(latest: Column) -> Column:
    """First of the month at the latest row's time of day."""
    return X.shift_days(latest, F.lit(1) - F.dayofmonth(latest))


RATE_COLUMNS_MISSING = "Required columns not found in data."


def tool_visits(e: Encounters) -> list[Metric]:
    return [row_count("total_visits")]


def tool_charges(e: Encounters) -> list[Metric]:
    column = e.need("charge", "tool_total", "No charge column found in data.")
    return [simple("total_charges", S.positive(e.number(column)))]


def tool_gross(e: Encounters) -> list[Metric]:
    charge = e.need("charge", "tool_rate", RATE_COLUMNS_MISSING)
    payment = e.need("payment", "tool_rate", RATE_COLUMNS_MISSING)
    parts = {"_rate_payments": S.amount(e.number(payment)), "_rate_charges": S.positive(e.number(charge))}
    paid, charged = F.col("_rate_payments"), F.col("_rate_charges")
    return [Metric("total_payments", parts, paid), Metric("total_charges", parts, charged),
            Metric("gcr_pct", parts, X.percent(paid, charged))]


def tool_net(e: Encounters) -> list[Metric]:
    payment = e.need("payment", "tool_rate", RATE_COLUMNS_MISSING)
    expected = e.need("expected", "tool_rate", RATE_COLUMNS_MISSING)
    parts = {"_rate_payments": S.amount(e.number(payment)), "_rate_expected": S.amount(e.number(expected))}
    paid, due = F.col("_rate_payments"), F.col("_rate_expected")
    return [Metric("total_payments", parts, paid), Metric("total_expected", parts, due),
            Metric("ncr_pct", parts, X.percent(paid, due))]


def _of_month(metrics, df: DataFrame, date_filter: str | None) -> DataFrame:
    e = Encounters.of(df)
    return evaluate(current_month(e, date_filter), metrics(e), stored=e.stored)


def tool_total_visits(df: DataFrame, date_filter: str | None = None) -> DataFrame:
    return _of_month(tool_visits, df, date_filter)


def tool_total_charges(df: DataFrame, date_filter: str | None = None) -> DataFrame:
    return _of_month(tool_charges, df, date_filter)


def tool_gross_collection_rate(df: DataFrame, date_filter: str | None = None) -> DataFrame:
    return _of_month(tool_gross, df, date_filter)


def tool_net_collection_rate(df: DataFrame, date_filter: str | None = None) -> DataFrame:
    return _of_month(tool_net, df, date_filter)


def tool_ar_parts(e: Encounters) -> dict[str, Part]:
    owed = e.need("balance", "tool", RATE_COLUMNS_MISSING)
    charge = e.need("charge", "tool_rate", RATE_COLUMNS_MISSING)
    e.need("service_date", "tool", RATE_COLUMNS_MISSING)
    return {"_ar": S.amount(e.number(owed)), "_ar_charges": S.positive(e.number(charge))}


def tool_days_in_ar(df: DataFrame, as_of=None) -> DataFrame:
    e = Encounters.of(df)
    period_parts, period = weekly_period(e, as_of, "tool")
    parts = {**tool_ar_parts(e), **period_parts}
    dated = e.slice("tool_ar").filter(e.time(e.find("service_date", "tool")).isNotNull())
    return evaluate(dated, [
        Metric("ending_ar", parts, F.col("_ar")),
        Metric("total_charges", parts, F.col("_ar_charges")),
        Metric("period_days", parts, period.cast("bigint")),
        Metric("days_in_ar", parts, ar_days(F.col("_ar"), F.col("_ar_charges"), period))], stored=e.stored)


def tool_ar_summary(df: DataFrame, as_of=None) -> DataFrame:
    """Total AR, two age buckets by service date, billed and unbilled with shares.

    Columns whose inputs the table lacks are null.
    """
    e = Encounters.of(df)
    return evaluate(e.slice("tool_ar"), summary_metrics(e, as_of), stored=e.stored)


def summary_metrics(e: Encounters, as_of) -> list[Metric]:
    owed = e.need("balance", "tool", "Balance column not found in data.")
    date, status = e.find("service_date", "tool"), e.find("status", "tool")
    ar = simple("total_ar", S.amount(e.number(owed)))
    absent = F.lit(None).cast("double")
    metrics = [ar]
    if date:
        metrics += ar_aging(e, date, owed, [AGING_31_60, AGING_60_PLUS], as_of)
    else:
        metrics += [Metric("ar_31_60", {}, absent), Metric("ar_60_90", {}, absent)]
    for name, statuses in (("billed_ar", SUMMARY_BILLED), ("unbilled_ar", SUMMARY_UNBILLED)):
        part = status_ar(e, owed, status, statuses, name) if status else Metric(name, {}, absent)
        share = F.when(ar.value() > 0, X.percent(part.value(), ar.value())).otherwise(F.lit(0.0))
        metrics += [part, Metric(f"{name}_pct", {**part.parts, **ar.parts},
                                 share if status else absent)]
    return metrics


# Registry of the interactive tools: name -> DataFrame function.
TOOLS = {
    "get_total_visits": tool_total_visits,
    "get_total_charges": tool_total_charges,
    "get_gross_collection_rate": tool_gross_collection_rate,
    "get_net_collection_rate": tool_net_collection_rate,
    "get_days_in_ar": tool_days_in_ar,
    "get_ar_summary": tool_ar_summary,
}
