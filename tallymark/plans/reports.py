"""The nine reports as tidy DataFrames, one row per period, week or code.

Every report reads the encounter table at most twice: once for the date it is
anchored to (one column), once for its aggregates. Anchors are scalar
subqueries, so the second read is filtered at the scan and nothing passes
through the driver. Windows without partitions only ever see aggregated rows,
whose number is that of periods or weeks. Given a rollup (``plans/rollup.py``),
the same reports add up its stored sums and do not read the encounters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import exprs as X
from tallymark.functions import parts as S
from tallymark.functions.exprs import Encounters, MissingColumns
from tallymark.operators import metrics as M

# Claim status words of the billing progress report.
PROCESSED_WORDS = ("completed", "payment received", "sent", "transmitted", "paid")
PENDING_WORDS = ("denial", "pending", "authorization", "missing auth")

# Statuses of the unbilled status report, in display order.
UNBILLED_REPORT_STATUSES = (
    "Approved", "On Hold", "Alert", "Pending Auth", "Reviewed", "Eligibility Failed",
    "Missing Facesheet", "Issues Pending", "Client Requested Hold")

BREAKDOWN_UNAVAILABLE = "visit created date not available"


# --- billing progress (slide 2) ----------------------------------------------------


def progress_metrics(e: Encounters, strict: bool = False) -> list[M.Metric]:
    charge = e.find("charge", "progress")
    paid = {f"_{c}": S.amount(e.number(c))
            for c in ("primary_payment", "secondary_payment", "tertiary_payment") if c in e.columns}
    insured = F.lit(0.0)
    for name in paid:
        insured = insured + F.col(name)
    nothing = F.lit(0).cast("bigint")
    claim = e.status("claim_status") if "claim_status" in e.columns else None

    def claims(name: str, words: tuple[str, ...]) -> M.Metric:
        if claim is None:
            return M.Metric(name, {}, nothing)
        return M.simple(name, S.tally(X.contains_any(claim, words, strict)))

    return [
        M.simple("charges", S.positive(e.number(charge))) if charge else M.constant("charges", 0.0),
        M.row_count("encounters"), M.Metric("insurance_payments", paid, insured),
        M.column_total(e, "patient_payment", "patient_payments"),
        claims("ar_claims_processed", PROCESSED_WORDS), claims("auth_denials_pending", PENDING_WORDS)]


def billing_progress(df: DataFrame, strict: bool = False) -> DataFrame:
    """Month of the latest service date, from its 1st to that date."""
    e = Encounters.of(df)
    date = e.need("service_date", "progress", "No date field found in data.")
    ts, rows = e.time(date), e.slice("progress")
    start, latest = X.anchors(rows, M.latest_month_start(F.max(ts)), F.max(ts))
    metrics = progress_metrics(e, strict)
    out = M.evaluate(rows.filter((ts >= start) & (ts <= latest)),
                     [M.simple("_last", F.max(ts)), *metrics], stored=e.stored)
    return out.filter(F.col("_last").isNotNull()).select(
        F.date_format("_last", "MMMM yyyy").alias("month_label"), *[m.name for m in metrics])


# --- weekly KPIs (slide 3) -----------------------------------------------------------


def total_metrics(e: Encounters) -> list[M.Metric]:
    return [M.total_visits(e), M.total_charges(e), M.rounded(M.charges_submitted_pct(e)),
            M.total_payments(e), M.rounded(M.gross_collection_rate(e)),
            M.rounded(M.net_collection_rate(e))]


def weekly_kpis(df: DataFrame, as_of=None) -> DataFrame:
    """Ten KPIs; despite the name they cover the whole table."""
    e = Encounters.of(df)
    aging = [M.ar_31_60(e, as_of), M.ar_60_plus(e, as_of)]
    metrics = [*total_metrics(e), M.days_in_ar_weekly(e, as_of), *aging, M.denial_resolution_rate()]
    if e.stored:
        # Ages are kept by billing date, the rest by service date.
        aged = [M.evaluate(e.slice("aging"), [m], stored=True).scalar() for m in aging]
        metrics[-3:-1] = [M.Metric(m.name, {}, c) for m, c in zip(aging, aged)]
    return M.evaluate(e.slice("totals"), metrics, stored=e.stored)


# --- quarterly and yearly (slides 4 and 5) ---------------------------------------------


def _usable(e: Encounters, valid: Column) -> Column:
    """Whether at least half of the rows are valid, as a scalar subquery."""
    n = F.col("_rows") if e.stored else F.lit(1)
    good, everything = F.sum(F.when(valid, n)), F.sum(n)
    share = e.slice("period").agg(((good > 0) & (good * 2 >= everything)).alias("usable"))
    return share.scalar()


def _whole_number(e: Encounters, column: str) -> Column:
    """A ready-made period column; a rollup keeps it as the whole number."""
    return F.col(column) if e.stored else e.number(column).cast("double").try_cast("int")


def _period_keys(e: Encounters, parts: tuple[str, ...]) -> tuple[dict[str, Column], bool]:
    """Grouping columns and whether they come from the service date alone.

    Ready-made period columns win if at least half of their rows are valid.
    """
    date = e.find("service_date", "period")
    derived = {}
    if date:
        ts = e.time(date)
        derived = {"year": F.year(ts), "quarter": F.quarter(ts)}
    if not all(p in e.columns for p in parts):
        if not date:
            what = "Year column or date field" if parts == ("year",) else \
                "Year/Quarter columns or date field"
            raise MissingColumns(f"No {what} found in data.")
        return {p: derived[p] for p in parts}, True
    ready = {p: _whole_number(e, p) for p in parts}
    valid = F.lit(True)
    for c in ready.values():
        valid = valid & c.isNotNull()
    usable = _usable(e, valid)
    unknown = F.lit(None).cast("int")
    return {p: F.when(usable, ready[p]).otherwise(derived.get(p, unknown)) for p in parts}, False


def _ar_columns(e: Encounters) -> tuple[Column, Column, Column] | None:
    """Balance, billed flag and service date, if the table has all three."""
    owed, status, date = (e.find("balance", "total"), e.find("status", "filtered"),
                          e.find("service_date"))
    if not (owed and status and date):
        return None
    billed = F.coalesce(e.status(status).isin(*X.BILLED), F.lit(False))
    return e.number(owed), billed, e.time(date)


def _keyed(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows with non-null period keys under reserved names."""
    for name, c in keys.items():
        rows = rows.withColumn(f"_key_{name}", c)
    for name in keys:
        rows = rows.filter(F.col(f"_key_{name}").isNotNull())
    return rows


def _period_metrics(e: Encounters, period: Column) -> list[M.Metric]:
    return [*total_metrics(e), M.days_in_ar_for(e, period)]


def period_parts(e: Encounters) -> list[M.Metric]:
    """What the yearly and quarterly reports add up."""
    ar = _ar_columns(e)
    by_date = [M.billed_ar(e), M.unbilled_ar(e)] if ar is None else ar_parts(e)
    return [*_period_metrics(e, F.lit(1)), M.simple("rows", S.tally()), *by_date]


def ar_parts(e: Encounters) -> list[M.Metric]:
    ar = _ar_columns(e)
    return [] if ar is None else list(_quarter_ar(ar, None))


YEAR_COLUMNS = ("year", "visits", "charges", "charges_submitted_pct", "payments",
                "gross_collection_rate_pct", "net_collection_rate_pct", "days_in_ar",
                "billed_ar", "unbilled_ar", "denial_resolution_rate_pct")

QUARTER_COLUMNS = ("year", "quarter", "visits", "charges", "charges_submitted_pct", "payments",
                   "gross_collection_rate_pct", "net_collection_rate_pct", "days_in_ar",
                   "billed_ar", "billed_ar_pct", "unbilled_ar", "unbilled_ar_pct",
                   "denial_resolution_rate_pct")


def _year_ar(ar, as_of) -> tuple[M.Metric, M.Metric]:
    """Billed and unbilled AR of a service year, up to Dec 31 or to today."""
    owed, billed, ts = ar
    today = X.day_of(X.as_of_time(as_of))
    year_end = X.midnight(F.make_date(F.year(ts), F.lit(12), F.lit(31)))
    counted = ts <= F.when(F.year(ts) < F.year(today), year_end).otherwise(today)
    return (M.simple("billed_ar", S.amount(owed, billed, counted)),
            M.simple("unbilled_ar", S.amount(owed, ~billed, counted)))


def yearly_kpis(df: DataFrame, as_of=None) -> DataFrame:
    e = Encounters.of(df)
    keys, from_date = _period_keys(e, ("year",))
    ar = _ar_columns(e)
    metrics = _period_metrics(e, M.yearly_period(F.col("_key_year"), as_of))
    rows = _keyed(e.slice("period"), keys)
    same_date = e.find("service_date", "period") == e.find("service_date")
    if ar is None:
        ar_metrics = [M.billed_ar(e), M.unbilled_ar(e)]
    elif from_date and same_date:
        ar_metrics = list(_year_ar(ar, as_of))
    else:
        ar_metrics = []
    out = M.evaluate(rows, [*metrics, *ar_metrics, M.denial_resolution_rate()], ["_key_year"],
                     e.stored)
    if not ar_metrics:
        by_date = M.evaluate(e.slice("ar").withColumn("_key_year", F.year(ar[2])),
                             _year_ar(ar, as_of), ["_key_year"], e.stored)
        out = out.join(by_date, "_key_year", "left").na.fill(0.0, ["billed_ar", "unbilled_ar"])
    return out.withColumnRenamed("_key_year", "year").select(*YEAR_COLUMNS)


def _quarter_ar(ar, as_of) -> tuple[M.Metric, M.Metric]:
    """Balance up to today of one service quarter; the suffix sum comes later."""
    owed, billed, ts = ar
    counted = ts <= X.day_of(X.as_of_time(as_of))
    return (M.simple("billed_ar", S.exact(owed, billed, counted)),
            M.simple("unbilled_ar", S.exact(owed, ~billed, counted)))


_QUARTER_KEYS = ["_key_year", "_key_quarter"]


def _to_today(quarters: DataFrame) -> DataFrame:
    """Per quarter, the sum over it and all later ones.

    The frame holds one row per quarter, so the window needs no partitioning.
    """
    onward = Window.orderBy(*_QUARTER_KEYS).rowsBetween(0, Window.unboundedFollowing)
    for name in ("billed_ar", "unbilled_ar"):
        quarters = quarters.withColumn(name, X.to_double(F.sum(name).over(onward)))
    return quarters


def quarterly_kpis(df: DataFrame, as_of=None, bounded: bool = False) -> DataFrame:
    """Twelve KPIs per quarter.

    Billed and unbilled AR run from the start of each quarter to today, also for
    past quarters; ``bounded`` ends them with the quarter.
    """
    e = Encounters.of(df)
    keys, from_date = _period_keys(e, ("year", "quarter"))
    ar = _ar_columns(e)
    metrics = _period_metrics(
        e, M.quarterly_period(F.col("_key_year"), F.col("_key_quarter"), as_of))
    rows = _keyed(e.slice("period"), keys)
    same_date = e.find("service_date", "period") == e.find("service_date")
    rate = M.denial_resolution_rate()
    if ar is None:
        out = M.evaluate(rows, [*metrics, M.billed_ar(e), M.unbilled_ar(e), rate], _QUARTER_KEYS,
                         e.stored)
    elif from_date and same_date:
        out = M.evaluate(rows, [*metrics, *_quarter_ar(ar, as_of), rate], _QUARTER_KEYS, e.stored)
        out = _exact_to_double(out) if bounded else _to_today(out)
    else:
        out = M.evaluate(rows, [*metrics, rate], _QUARTER_KEYS, e.stored)
        dated = _keyed(e.slice("ar"), {"year": F.year(ar[2]), "quarter": F.quarter(ar[2])})
        sums = M.evaluate(dated, _quarter_ar(ar, as_of), _QUARTER_KEYS, e.stored)
        # Reported quarters may hold no service date, so they join the running sum as zeros.
        zeros = out.select(*_QUARTER_KEYS, F.lit(0).alias("billed_ar"),
                           F.lit(0).alias("unbilled_ar"))
        sums = (sums.unionByName(zeros).groupBy(*_QUARTER_KEYS)
                .agg(F.sum("billed_ar").alias("billed_ar"),
                     F.sum("unbilled_ar").alias("unbilled_ar")))
        sums = _exact_to_double(sums) if bounded else _to_today(sums)
        out = out.join(sums, _QUARTER_KEYS, "left")
    billed, unbilled = F.col("billed_ar"), F.col("unbilled_ar")
    for name, c in (("billed_ar_pct", billed), ("unbilled_ar_pct", unbilled)):
        share = F.when(billed + unbilled > 0, X.percent(c, billed + unbilled)).otherwise(F.lit(0.0))
        out = out.withColumn(name, F.round(share, 2))
    return (out.withColumnRenamed("_key_year", "year")
            .withColumnRenamed("_key_quarter", "quarter").select(*QUARTER_COLUMNS))


def _exact_to_double(quarters: DataFrame) -> DataFrame:
    for name in ("billed_ar", "unbilled_ar"):
        quarters = quarters.withColumn(name, X.to_double(F.col(name)))
    return quarters


def quarterly_billed_ar(df: DataFrame, as_of=None, bounded: bool = False) -> DataFrame:
    """Billed and unbilled AR per service quarter alone."""
    e = Encounters.of(df)
    ar = _ar_columns(e)
    if ar is None:
        raise MissingColumns("Balance, status and service date are needed.")
    rows = _keyed(e.slice("ar"), {"year": F.year(ar[2]), "quarter": F.quarter(ar[2])})
    out = M.evaluate(rows, _quarter_ar(ar, as_of), _QUARTER_KEYS, e.stored)
    out = _exact_to_double(out) if bounded else _to_today(out)
    return (out.withColumnRenamed("_key_year", "year")
            .withColumnRenamed("_key_quarter", "quarter"))


def latest_quarter(quarterly: DataFrame) -> DataFrame:
    return quarterly.orderBy(F.desc("year"), F.desc("quarter")).limit(1)


# --- weekly breakdown (slide 6) ---------------------------------------------------------


def month_weeks(anchor: DataFrame) -> DataFrame:
    """Tuesday-to-Monday weeks of the month starting at ``anchor.month_start``."""
    days = anchor.filter(F.col("month_start").isNotNull()).select(
        "month_start",
        F.explode(F.sequence("month_start", F.last_day("month_start"))).alias("day"))
    return (days.groupBy("month_start", X.tuesday_week(F.col("day")).alias("week"))
            .agg(F.min("day").alias("week_start"), F.max("day").alias("week_end"),
                 F.count(F.lit(1)).cast("int").alias("days")))


def created_metrics(e: Encounters) -> list[M.Metric]:
    paid = e.number("total_payment") if "total_payment" in e.columns else F.lit(0.0)
    # Null without positive payments; the sum stays exact until weeks are added up.
    return [M.simple("_n", S.tally()), M.simple("_paid", S.Part(paid, paid > 0, finish=lambda total: total))]


def weekly_breakdown(df: DataFrame, as_of=None, year: int | None = None,
                     month: int | None = None) -> DataFrame:
    """Cumulative forecast and actuals per week of the latest created month.

    The forecast is the daily average of the three complete months before.
    Without a created date the weeks are listed with null figures.
    """
    e = Encounters.of(df)
    spark = e.df.sparkSession
    given = year is not None and month is not None
    created = e.find("created_date")
    anchor_date = created or e.find("service_date", "breakdown")
    if given:
        start = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    elif anchor_date:
        newest = e.slice("created").agg(X.month_start(F.max(e.time(anchor_date))).alias("month_start"))
        start = newest.scalar()
        if not created:
            start = F.coalesce(start, X.month_start(X.as_of_time(as_of)))
    else:
        start = X.month_start(X.as_of_time(as_of))
    weeks = month_weeks(spark.range(1).select(start.alias("month_start")))
    if not created:
        figures = weeks.select(
            "*", *[F.lit(None).cast("bigint").alias(n) for n in ("_n", "_base_n")],
            *[F.lit(None).cast("double").alias(n) for n in ("_paid", "_base_paid")])
        return _breakdown_columns(figures)

    ts = e.time(created)
    base_start = F.add_months(start, -3)
    day = ts.cast("date")
    # Ranges end at midnight of their last day: later rows of that day count nowhere.
    month_end, week = F.last_day(day), X.tuesday_week(day)
    next_monday = F.next_day(F.date_sub(day, 1), "Mon")
    week_end = F.least(next_monday, month_end)
    in_base = (ts < X.midnight(start)) & (ts <= X.midnight(month_end))
    in_week = (ts >= X.midnight(start)) & (ts <= X.midnight(week_end))
    month = e.slice("created").filter((ts >= X.midnight(base_start)) & (ts < X.midnight(F.add_months(start, 1))))
    sums = (M.evaluate(month.withColumn("_key_week", F.when(in_base, F.lit(0)).when(in_week, week)),
                       created_metrics(e), ["_key_week"], e.stored)
            .withColumnRenamed("_key_week", "week").filter(F.col("week").isNotNull()))
    # At most seven rows: the base (week 0) and the weeks of one month.
    slots = weeks.join(sums, "week", "full")
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding,
                                                  Window.unboundedFollowing)
    so_far = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    base = F.col("week") == 0
    figures = (slots
               .withColumn("_base_n", F.coalesce(F.max(F.when(base, F.col("_n"))).over(everything),
                                                 F.lit(0)))
               .withColumn("_base_paid", F.coalesce(X.to_double(
                   F.max(F.when(base, F.col("_paid"))).over(everything)), F.lit(0.0)))
               .filter(F.col("week") > 0)
               .withColumn("_n", F.coalesce(F.sum("_n").over(so_far), F.lit(0)))
               .withColumn("_paid", F.coalesce(X.to_double(F.sum("_paid").over(so_far)),
                                               F.lit(0.0))))
    return _breakdown_columns(figures)


def _breakdown_columns(figures: DataFrame) -> DataFrame:
    start = F.col("month_start")
    base_days = F.datediff(start, F.add_months(start, -3))
    daily_n = X.to_double(F.col("_base_n")) / base_days
    daily_paid = F.col("_base_paid") / base_days
    so_far = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    days = F.sum("days").over(so_far)
    return figures.select(
        F.year(start).alias("year"), F.month(start).alias("month"),
        F.date_format(start, "MMMM").alias("month_name"),
        F.concat(F.date_format(F.add_months(start, -3), "yyyy-MM"), F.lit(" to "),
                 F.date_format(F.add_months(start, -1), "yyyy-MM")).alias("forecast_period"),
        F.round(daily_n, 2).alias("avg_daily_visits"),
        F.round(daily_paid, 2).alias("avg_daily_collections"),
        "week", F.date_format("week_start", "yyyy-MM-dd").alias("week_start"),
        F.date_format("week_end", "yyyy-MM-dd").alias("week_end"), "days",
        F.bround(daily_n * days, 0).cast("bigint").alias("forecasted_visits"),
        F.col("_n").alias("actual_visits"),
        F.round(daily_paid * days, 2).alias("forecasted_collections"),
        F.round("_paid", 2).alias("actual_collections"))


def forecast_base(df: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows and positive payments of each of the three months before the latest one."""
    e = Encounters.of(df)
    created = e.need("created_date", "default", "No created date column found.")
    ts = e.time(created)
    if year is not None and month is not None:
        start = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    else:
        start = e.df.agg(X.month_start(F.max(ts)).alias("month_start")).scalar()
    paid = e.number("total_payment") if "total_payment" in e.columns else F.lit(0.0)
    month_key = X.month_start(ts)
    rows = e.df.filter((ts >= X.midnight(F.add_months(start, -3))) & (ts < X.midnight(start))
                       & (ts <= X.midnight(F.last_day(ts.cast("date")))))
    return (rows.groupBy(month_key.alias("month_start"))
            .agg(F.count(F.lit(1)).alias("visits"), X.positive_total(paid).alias("collections"))
            .select(F.date_format("month_start", "yyyy-MM").alias("month"),
                    F.dayofmonth(F.last_day("month_start")).alias("days"),
                    "visits", "collections"))


# --- client week and month to date (slides 7 and 8) ----------------------------------------


def weekly_comparison(df: DataFrame) -> DataFrame:
    """The seven days ending at the latest service date.

    Visits and charges go by service date, collections by transaction date where
    the table has one.
    """
    e = Encounters.of(df)
    date = e.need("service_date", "default", "No date field found in data.")
    ts = e.time(date)
    transaction = e.find("transaction_date")
    week = X.anchors(e.slice("served"), X.shift_days(F.max(ts), -6), F.max(ts))
    served = ts.between(*week)
    collected = e.time(transaction).between(*week) if transaction else served
    visits = M.simple("visits", S.tally(dated=served))
    collections, charges = M.filtered_payments(e, collected), M.filtered_charges(e, served)
    if e.stored:
        # Collections are kept by transaction date, of rows that have a service date.
        rows = e.slice("served").filter(ts.isNotNull())
        by_transaction = M.evaluate(e.slice("collected"), [collections], stored=True).scalar()
        collections = M.Metric(collections.name, {}, by_transaction)
    else:
        rows = e.df.filter(ts.isNotNull() & (served | collected))
    bounds = {"_last": F.max(F.when(served, ts))}
    last = F.col("_last")
    text = "MM/dd/yyyy"
    out = M.evaluate(rows, [
        M.Metric("_week_end", bounds, last),
        M.Metric("week_start", bounds, F.date_format(X.shift_days(last, -6), text)),
        M.Metric("week_end", bounds, F.date_format(last, text)),
        M.Metric("collections_dos", collections.parts, collections.value()),
        M.Metric("collections_dc", collections.parts, collections.value()),
        M.Metric("charges_dos", charges.parts, charges.value()),
        M.Metric("charges_dc", charges.parts, charges.value()),
        M.Metric("visits_dos", visits.parts, visits.value()),
        M.Metric("visits_dc", visits.parts, visits.value())], stored=e.stored)
    return out.filter(F.col("_week_end").isNotNull()).drop("_week_end")


def month_metrics(e: Encounters) -> list[M.Metric]:
    collections, charges = M.filtered_payments(e), M.filtered_charges(e)
    return [M.Metric("collections", collections.parts, collections.value()),
            M.Metric("charges", charges.parts, charges.value()), M.total_visits(e)]


def month_to_date(df: DataFrame, as_of=None) -> DataFrame:
    """This month to the latest day, and the same days of the three months before.

    With ``as_of``, later rows do not count.
    """
    e = Encounters.of(df)
    date = e.need("service_date", "month_to_date", "No visit_date field found in data.")
    ts, known = e.time(date), e.slice("month")
    if as_of is not None:
        known = known.filter(ts <= X.as_of_time(as_of))
    spark = e.df.sparkSession
    latest = known.agg(F.max(ts).cast("date").alias("latest")).scalar()
    day = ts.cast("date")
    cutoff = F.least(F.dayofmonth(latest), F.dayofmonth(F.last_day(day)))
    # The range ends at midnight of its last day.
    last_moment = X.midnight(F.date_add(F.trunc(day, "month"), cutoff - 1))
    earliest, = X.anchors(known, X.midnight(F.add_months(F.trunc(F.max(ts).cast("date"), "month"), -3)))
    rows = known.filter((ts >= earliest) & (ts <= last_moment))
    rows = rows.withColumn("_key_month", F.trunc(day, "month"))
    sums = M.evaluate(rows, month_metrics(e), ["_key_month"], e.stored)
    months = (spark.range(4).select(F.col("id").cast("int").alias("months_back"),
                                    latest.alias("latest"))
              .filter(F.col("latest").isNotNull())
              .withColumn("_key_month", F.add_months(F.trunc("latest", "month"),
                                                     -F.col("months_back"))))
    end_day = F.least(F.dayofmonth("latest"), F.dayofmonth(F.last_day("_key_month")))
    out = months.join(sums, "_key_month", "left").na.fill(0.0, ["collections", "charges"]) \
        .na.fill(0, ["visits"])
    return out.select(
        "months_back",
        F.concat(F.date_format("_key_month", "MMM dd"), F.lit(" - "),
                 F.date_format(F.date_add("_key_month", end_day - 1), "MMM dd, yyyy"))
        .alias("month_label"),
        F.date_format("_key_month", "MMMM yyyy").alias("month_name"),
        F.concat(F.lit("1-"), F.dayofmonth("latest").cast("string")).alias("day_range"),
        "collections", "charges", "visits")


# --- unbilled status (slide 9) ----------------------------------------------------------------


def _not_billed(e: Encounters) -> tuple[Column, Column]:
    """Status of a visit, and whether it is not billed."""
    label = e.status(e.need("status", "unbilled_week", "No visit_status column found"))
    return label, X.outside(label, X.BILLED)


def unbilled_metrics(e: Encounters) -> list[M.Metric]:
    label, open_ = _not_billed(e)
    return [*[M.Metric(s, {f"_{s}": S.tally(open_ & (label == s.lower()))}, F.col(f"`_{s}`"))
              for s in UNBILLED_REPORT_STATUSES], M.simple("Total", S.tally(open_))]


def _open_visits(e: Encounters) -> tuple[DataFrame, Column]:
    """Visits that are not billed, or the stored days that have some, and their date."""
    _, open_ = _not_billed(e)
    ts = e.time(e.need("service_date", "unbilled_week", "No date column found"))
    picked = F.col("_Total") > 0 if e.stored else open_
    return e.slice("unbilled").filter(ts.isNotNull() & picked), ts


def unbilled_status_week(df: DataFrame, by_label: bool = False) -> DataFrame:
    """Visits per unbilled status in the last completed Monday-to-Sunday week.

    The last row totals the week, including statuses outside the nine listed.
    ``by_label`` selects weeks by their display label, which repeats every year.
    """
    e = Encounters.of(df)
    rows, ts = _open_visits(e)
    newest = F.max(ts)
    last_sunday = F.date_sub(newest.cast("date"), F.dayofweek(newest) - 1)
    first_day = F.date_sub(last_sunday, 6)
    monday, sunday = X.anchors(rows, first_day, last_sunday)
    if by_label:
        label_of_week, = X.anchors(rows, X.week_label(first_day))
        week = rows.filter(X.week_label(X.monday_of(ts)) == label_of_week)
    else:
        start, end = X.anchors(rows, X.midnight(first_day), X.midnight(F.date_add(last_sunday, 1)))
        week = rows.filter((ts >= start) & (ts < end))
    counts = M.evaluate(week, unbilled_metrics(e), stored=e.stored)
    ordered = (*UNBILLED_REPORT_STATUSES, "Total")
    out = counts.select(F.posexplode(F.array(*[
        F.struct(F.lit(s).alias("status"), F.col(f"`{s}`").alias("visits")) for s in ordered])))
    return out.select(
        (F.col("pos") + 1).alias("position"), F.col("col.status").alias("status"),
        F.concat(F.date_format(monday, "MMM dd"), F.lit(" - "), F.date_format(sunday, "MMM dd"))
        .alias("week"),
        F.col("col.visits").alias("visits")).filter(F.col("week").isNotNull())


def week_labels(df: DataFrame) -> DataFrame:
    """Week labels of unbilled visits with the earliest Monday each stands for."""
    e = Encounters.of(df)
    rows, ts = _open_visits(e)
    monday = X.monday_of(ts)
    total = [m for m in unbilled_metrics(e) if m.name == "Total"]
    return M.evaluate(rows.withColumn("week_label", X.week_label(monday)), [
        M.Metric("first_monday", {"_first": F.min(monday)}, F.col("_first")),
        M.Metric("visits", total[0].parts, total[0].value())], ["week_label"], e.stored)
