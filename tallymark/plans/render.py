"""The report deck as lines of text.

Each slide becomes one row holding its lines, built from the small report
frames with SQL string functions; the deck is their union. Only a caller that
wants the finished text collects it, and its size is that of the printed report.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.exprs import Encounters, MissingColumns
from tallymark.functions.roles import CANDIDATES, resolve
from tallymark.functions.text import two_decimals
from tallymark.operators import denials as D
from tallymark.operators import metrics as M
from tallymark.plans import reports as R

# Wording and layout of the report text.
SEPARATOR = "\n\n" + "═" * 65 + "\n\n"
TWO_COLUMNS = ("| Type | Value |", "|------|-------|")
METRIC_VALUE = ("| Metric | Value |", "|--------|-------|")
METRIC_AMOUNT = ("| Metric | Amount |", "|--------|--------|")
WEEK_HEAD = ("| Week | Forecasted | Actual |", "|------|------------|--------|")
MONTH_HEAD = ("| Month | Collections | Charges | Visits |",
              "|-------|-------------|---------|--------|")
NO_DATES = "No valid dates found in data."
BOX_EDGE = "═" * 62
THIN_RULE, MID_RULE = "─" * 64, "━" * 60
CELL = 17
LABEL_WIDTH = 28


# --- formatting -------------------------------------------------------------------


def dollars(c: Column, digits: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, digits))


def whole(c: Column) -> Column:
    return F.format_number(c, 0)


def percent(c: Column) -> Column:
    return F.concat(two_decimals(c), F.lit("%"))


def days(c: Column) -> Column:
    return F.concat(c.cast("string"), F.lit(" Days"))


# Label, column and format of each KPI, in print order.
KPI_ROWS = {
    "visits": ("Visits", whole), "charges": ("Charges", dollars),
    "charges_submitted_pct": ("Charges Submitted (%)", percent),
    "payments": ("Payments", dollars),
    "gross_collection_rate_pct": ("Gross Collection Rate (%)", percent),
    "net_collection_rate_pct": ("Net Collection Rate (%)", percent),
    "days_in_ar": ("Days in AR (DAR)", days),
    "ar_31_60_days": ("A/R (31-60 Days)", dollars),
    "ar_60_plus_days": ("A/R (60+ Days)", dollars),
    "billed_ar": ("Billed AR", dollars), "billed_ar_pct": ("Billed AR %", percent),
    "unbilled_ar": ("Unbilled AR", dollars), "unbilled_ar_pct": ("Unbilled AR (%)", percent),
    "denial_resolution_rate_pct": ("Denial vs Resolution (%)", percent),
}


def _cell(column: str):
    """Reads a KPI of a collected row and formats it."""
    return lambda row: KPI_ROWS[column][1](row[column])


def _lit_lines(lines) -> Column:
    return F.array(*[F.lit(line) if isinstance(line, str) else line for line in lines])


def _row(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"| {label} | "), value, F.lit(" |"))


def _kpi_rows(columns) -> list[Column]:
    return [_row(KPI_ROWS[c][0], KPI_ROWS[c][1](F.col(c))) for c in columns if c in KPI_ROWS]


def _one(df: DataFrame, lines, empty: str) -> DataFrame:
    """Lines of a report of one row, or a single line if it has none."""
    text = df.select(_lit_lines(lines).alias("lines"))
    return text.agg(F.coalesce(F.max("lines"), F.array(F.lit(empty))).alias("lines"))


def _many(df: DataFrame, order: str, line: Column) -> Column:
    """Aggregate: one line per row of a small report, in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"),
                                                            line.alias("line")))),
                       lambda r: r["line"])


# --- slides --------------------------------------------------------------------------


def billing_progress_slide(e: Encounters, company: str, as_of) -> DataFrame:
    title = F.concat(F.lit(f"## SLIDE 2: {company} - BILLING PROGRESS ("), F.col("month_label"),
                     F.lit(")"))
    return _one(R.billing_progress(e), [
        title, "", *METRIC_VALUE,
        _row("Charges", dollars(F.col("charges"), 0)), _row("Encounters", whole(F.col("encounters"))),
        _row("Insurance Payments Posted", dollars(F.col("insurance_payments"), 0)),
        _row("Patient Payments Posted", dollars(F.col("patient_payments"), 0)),
        _row("A/R Claims processed", whole(F.col("ar_claims_processed"))),
        _row("Authorization denials/ Pending claims", whole(F.col("auth_denials_pending")))],
        _progress_error(company, NO_DATES))


def _progress_error(company: str, message: str) -> str:
    return f"## {company} - BILLING PROGRESS (Current Month)\n\nError: {message}"


def weekly_kpi_slide(e: Encounters, company: str, as_of) -> DataFrame:
    df = R.weekly_kpis(e, as_of)
    return _one(df, [f"## SLIDE 3: {company} - KPI METRICS WEEKLY", "", *TWO_COLUMNS,
                     *_kpi_rows(df.columns)], "")


def quarterly_slide(e: Encounters, company: str, as_of) -> DataFrame:
    title = F.concat(F.lit(f"## SLIDE 4: {company} - KPI METRICS QUARTERLY (Q"),
                     F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string"),
                     F.lit(")"))
    return _one(R.latest_quarter(R.quarterly_kpis(e, as_of)),
                [title, "", *TWO_COLUMNS, *_kpi_rows(R.QUARTER_COLUMNS)], f"❌ Error: {NO_DATES}")


def yearly_slide(e: Encounters, company: str, as_of) -> DataFrame:
    df = R.yearly_kpis(e, as_of)
    years = df.agg(F.array_sort(F.collect_list(F.struct(*R.YEAR_COLUMNS))).alias("rows"))

    def across(fmt) -> Column:
        return F.array_join(F.transform("rows", fmt), " | ")

    body = [_row(KPI_ROWS[c][0], across(_cell(c))) for c in KPI_ROWS if c in R.YEAR_COLUMNS]
    lines = [f"## SLIDE 5: {company} - KPI METRICS YEAR OVER YEAR", "",
             _row("Type", across(lambda r: r["year"].cast("string"))),
             F.concat(F.lit("|------|"), F.repeat(F.lit("------|"), F.size("rows"))), *body]
    return years.select(F.when(F.size("rows") > 0, _lit_lines(lines)).otherwise(
        F.array(F.lit(f"❌ Error: {NO_DATES}"))).alias("lines"))


def breakdown_slide(e: Encounters, company: str, as_of) -> DataFrame:
    def cells(fmt, forecast: str, actual: str) -> Column:
        def shown(c: str) -> Column:
            return F.coalesce(fmt(F.col(c)), F.lit(R.BREAKDOWN_UNAVAILABLE))
        return F.concat(F.lit("| Week "), F.col("week").cast("string"), F.lit(" | "),
                        shown(forecast), F.lit(" | "), shown(actual), F.lit(" |"))

    df = R.weekly_breakdown(e, as_of)
    weeks = df.agg(
        F.max(F.concat("month_name", F.lit(" "), F.col("year").cast("string"))).alias("month"),
        _many(df, "week", cells(dollars, "forecasted_collections", "actual_collections"))
        .alias("collections"),
        _many(df, "week", cells(whole, "forecasted_visits", "actual_visits")).alias("visits"))
    title = F.concat(F.lit(f"## SLIDE 6: {company} - WEEKLY BREAKDOWN ("), F.col("month"), F.lit(")"))
    lines = F.concat(
        _lit_lines([title, "", "### Weekly Collections", "", *WEEK_HEAD]), F.col("collections"),
        _lit_lines(["", "### Weekly Visits", "", *WEEK_HEAD]), F.col("visits"))
    empty = "❌ Error: No valid dates found in Visit Created Date column."
    return weeks.select(F.when(F.size("visits") > 0, lines).otherwise(
        F.array(F.lit(empty))).alias("lines"))


def client_week_slide(e: Encounters, company: str, as_of) -> DataFrame:
    title = F.concat(F.lit(f"## SLIDE 7: {company} - CLIENT SUMMARY WEEKLY ("), F.col("week_start"),
                     F.lit(" - "), F.col("week_end"), F.lit(")"))
    return _one(R.weekly_comparison(e), [
        title, "", *METRIC_AMOUNT, _row("Collections", dollars(F.col("collections_dc"))),
        _row("Charges", dollars(F.col("charges_dc"))), _row("Visits", whole(F.col("visits_dc")))],
        f"❌ Error: {NO_DATES}")


def month_to_date_slide(e: Encounters, company: str, as_of) -> DataFrame:
    df = R.month_to_date(e)
    line = F.concat(F.lit("| "), F.col("month_name"), F.lit(" | "), dollars(F.col("collections")),
                    F.lit(" | "), dollars(F.col("charges")), F.lit(" | "), whole(F.col("visits")),
                    F.lit(" |"))
    months = df.agg(F.max("day_range").alias("day_range"),
                    _many(df, "months_back", line).alias("rows"))
    title = F.concat(F.lit(f"## SLIDE 8: {company} - CLIENT SUMMARY MONTH TO DATE (Day Range: "),
                     F.col("day_range"), F.lit(")"))
    return months.select(F.when(
        F.size("rows") > 0, F.concat(_lit_lines([title, "", *MONTH_HEAD]), F.col("rows")))
        .otherwise(F.array(F.lit(f"❌ Error: {NO_DATES}"))).alias("lines"))


def unbilled_slide(e: Encounters, company: str, as_of) -> DataFrame:
    df = R.unbilled_status_week(e)
    count = F.col("visits").cast("string")
    plain = F.concat(F.lit("| "), F.col("status"), F.lit(" | "), count, F.lit(" | "), count,
                     F.lit(" |"))
    bold = F.concat(F.lit("| **Total** | **"), count, F.lit("** | **"), count, F.lit("** |"))
    rows = df.agg(F.max("week").alias("week"), _many(
        df, "position", F.when(F.col("status") == "Total", bold).otherwise(plain)).alias("rows"))
    head = F.concat(F.lit("| Visit Status | "), F.col("week"), F.lit(" | Grand Total |"))
    lines = F.concat(_lit_lines([f"## SLIDE 9: {company} - UNBILLED STATUS", "", head,
                                 "|--------------|------|-------------|"]), F.col("rows"))
    empty = "❌ Error generating unbilled status report: No data after filtering"
    return rows.select(F.when(F.size("rows") > 0, lines).otherwise(
        F.array(F.lit(empty))).alias("lines"))


def denials_slide(e: Encounters, company: str, as_of) -> DataFrame:
    """Codes by state, zeros filled in. States and cells are bounded by the states."""
    top = D.top_codes_with_cells(e)
    states = D.denial_states(e).agg(F.array_sort(F.collect_list("state")).alias("states")).scalar()
    known = F.filter("cells", lambda c: c["state"].isNotNull())
    table = top.agg(
        F.array_sort(F.collect_list(F.struct(
            (-F.col("total_visits")).alias("rank"), "code", "sample_description",
            known.alias("cells")))).alias("codes")).select("codes", states.alias("states"))

    def cell(cells: Column, state: Column, bold: str) -> Column:
        here = F.filter(cells, lambda c: c["state"] == state)
        n = F.aggregate(here, F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
        # Summed exactly, then shown as double.
        kind = "decimal(38,4)"
        paid = F.aggregate(here, F.lit(0).cast(kind), lambda a, c: (
            a + F.coalesce(c["expected"], F.lit(0))).cast(kind)).cast("double")
        mark = F.lit(bold)
        return F.concat(F.lit(" "), mark, n.cast("string"), mark, F.lit(" | "), mark,
                        dollars(paid), mark, F.lit(" |"))

    def code_line(row: Column) -> Column:
        text = row["sample_description"]
        after = F.when(F.contains(text, F.lit(":")),
                       F.trim(F.regexp_replace(text, "^[^:]*:", ""))).otherwise(text)
        return F.concat(F.lit("| "), row["code"], F.lit(" | "), after, F.lit(" |"), F.array_join(
            F.transform("states", lambda s: cell(row["cells"], s, "")), ""))

    everything = F.flatten(F.transform("codes", lambda r: r["cells"]))
    head = F.concat(F.lit("| Denial Code | Description |"), F.array_join(F.transform(
        "states", lambda s: F.concat(F.lit(" "), s, F.lit(" Count | "), s, F.lit(" Expected |"))), ""))
    rule = F.concat(F.lit("|-------------|-------------|"),
                    F.repeat(F.lit("------|------|"), F.size("states")))
    totals = F.concat(F.lit("| **Total** | |"), F.array_join(
        F.transform("states", lambda s: cell(everything, s, "**")), ""))
    lines = F.concat(
        _lit_lines([f"## SLIDE 11: {company} - TOP 15 DENIAL CATEGORIES (All Time)", "", head, rule]),
        F.transform("codes", code_line),
        _lit_lines([totals, "", F.concat(F.lit("*Generated: "), F.lit(_stamp(as_of)), F.lit("*"))]))
    return table.select(
        F.when(F.size("codes") == 0, F.array(F.lit(
            "❌ Error generating denial categories report: No denial data found")))
        .when(F.size("states") == 0, F.array(F.lit("❌ No denial categories data available.")))
        .otherwise(lines).alias("lines"))


def _stamp(as_of) -> str:
    if as_of is None:
        return dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if not isinstance(as_of, dt.datetime):
        as_of = dt.datetime(as_of.year, as_of.month, as_of.day)
    return as_of.strftime("%Y-%m-%d %H:%M:%S")


# Slide number -> builder and the prefix of its error line. There is no slide 10.
SLIDES = {
    2: (billing_progress_slide, None),
    3: (weekly_kpi_slide, "❌ Error: "),
    4: (quarterly_slide, "❌ Error: "),
    5: (yearly_slide, "❌ Error: "),
    6: (breakdown_slide, "❌ Error: "),
    7: (client_week_slide, "❌ Error: "),
    8: (month_to_date_slide, "❌ Error: "),
    9: (unbilled_slide, "❌ Error generating unbilled status report: "),
    11: (denials_slide, "❌ Error generating denial categories report: "),
}


def deck_columns(e: Encounters) -> list[str]:
    """The columns some slide may read, so that staging a view writes no others."""
    fixed = {"visit_id", "visit_status", "claim_status", "total_payment", "primary_payment",
             "secondary_payment", "tertiary_payment", "patient_payment", "charges_submitted",
             "year", "quarter"}
    found = {resolve(e.columns, role, context) for role, context in CANDIDATES}
    return [c for c in e.columns if c in fixed | found]


def report_lines(df: DataFrame, company: str = "Company", as_of=None,
                 slides=tuple(SLIDES)) -> DataFrame:
    """(slide, line_no, text) of the asked slides.

    A slide whose columns are missing holds its error instead; the others are
    not affected. Given encounters, slides scan them one by one, each reading its
    own few columns; given a ``Rollup``, they read its stored sums.
    """
    e = Encounters.of(df)
    company = company.upper()
    frames = []
    for number in slides:
        build, prefix = SLIDES[number]
        try:
            frame = build(e, company, as_of)
        except MissingColumns as missing:
            text = _progress_error(company, str(missing)) if prefix is None else prefix + str(missing)
            frame = e.df.sparkSession.range(1).select(F.array(F.lit(text)).alias("lines"))
        frames.append(frame.select(F.lit(number).alias("slide"), F.posexplode("lines")
                                   .alias("line_no", "text")))
    deck = reduce(DataFrame.unionByName, frames)
    return deck.select("slide", (F.col("line_no") + 1).alias("line_no"), "text")


def report_text(lines: DataFrame) -> str:
    """The deck as one text, slides in order with a separator between them."""
    parts: dict[int, list[str]] = {}
    for row in lines.orderBy("slide", "line_no").collect():
        parts.setdefault(row["slide"], []).append(row["text"])
    return SEPARATOR.join("\n".join(lines) for lines in parts.values()).strip()


def write_report(lines: DataFrame, path: str) -> None:
    """The deck as one text file; its size is that of the printed report."""
    (lines.repartition(1).sortWithinPartitions("slide", "line_no").select("text")
     .write.text(path))


# --- answers of the interactive tools ------------------------------------------------------


def _lines(*parts) -> Column:
    return F.array_join(_lit_lines(parts), "\n")


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: "), value)


def _bold(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- **{label}: "), value, F.lit("**"))


def _answer(name: str, period: str) -> Column:
    c = F.col
    if name == "get_total_visits":
        return F.concat(F.lit(f"**Total Visits{period}:** "), whole(c("total_visits")))
    if name == "get_total_charges":
        return F.concat(F.lit(f"**Total Charges{period}:** "), dollars(c("total_charges")))
    if name == "get_gross_collection_rate":
        return _lines(f"**Gross Collection Rate{period}:**",
                      _labelled("Total Payments", dollars(c("total_payments"))),
                      _labelled("Total Charges", dollars(c("total_charges"))),
                      _bold("GCR", percent(c("gcr_pct"))))
    if name == "get_net_collection_rate":
        return _lines(f"**Net Collection Rate{period}:**",
                      _labelled("Total Payments", dollars(c("total_payments"))),
                      _labelled("Total Expected", dollars(c("total_expected"))),
                      _bold("NCR", percent(c("ncr_pct"))))
    if name == "get_days_in_ar":
        note = " (365 for full year, or YTD for current year)"
        return _lines("**Days in AR:**", _labelled("Ending AR", dollars(c("ending_ar"))),
                      _labelled("Total Charges", dollars(c("total_charges"))),
                      _labelled("Period Days", F.concat(c("period_days").cast("string"), F.lit(note))),
                      _bold("DAR", days(c("days_in_ar"))))

    def share(part: str) -> Column:
        return F.concat(dollars(c(part)), F.lit(" ("), percent(c(f"{part}_pct")), F.lit(")"))

    # Blocks whose inputs the table lacks are null and left out.
    aging = F.concat(F.lit("**AR Aging:**\n"), _labelled("31-60 Days", dollars(c("ar_31_60"))),
                     F.lit("\n"), _labelled("60-90 Days", dollars(c("ar_60_90"))))
    billed = F.concat(F.lit("**Billed vs Unbilled AR:**\n"), _labelled("Billed AR", share("billed_ar")),
                      F.lit("\n"), _labelled("Unbilled AR", share("unbilled_ar")))
    return F.concat_ws("\n", F.lit("**AR Summary:**"), _labelled("Total AR", dollars(c("total_ar"))),
                       aging, billed)


def tool_answer(name: str, df: DataFrame, as_of=None, date_filter: str | None = None) -> DataFrame:
    """(tool, answer): what an interactive metric tool replies."""
    e = Encounters.of(df)
    dated = name in ("get_days_in_ar", "get_ar_summary")
    try:
        frame = M.TOOLS[name](e, as_of) if dated else M.TOOLS[name](e, date_filter)
    except MissingColumns as missing:
        frame, text = e.df.sparkSession.range(1), F.lit(f"❌ {missing}")
    else:
        text = _answer(name, f" ({date_filter})" if date_filter else "")
    return frame.select(F.lit(name).alias("tool"), text.alias("answer"))


def tool_answers(df: DataFrame, as_of=None, date_filter: str | None = None) -> DataFrame:
    """Answers of all tools; each reads its own few columns."""
    e = Encounters.of(df)
    return reduce(DataFrame.unionByName, [tool_answer(n, e, as_of, date_filter) for n in M.TOOLS])


# --- all quarters -----------------------------------------------------------------------


def all_quarters_lines(df: DataFrame, company: str = "Company", as_of=None) -> DataFrame:
    """Every quarter of every year side by side, as (line_no, text)."""
    quarters = R.quarterly_kpis(df, as_of)
    per_year = quarters.groupBy("year").agg(F.array_sort(F.collect_list(
        F.struct("quarter", *[c for c in R.QUARTER_COLUMNS if c in KPI_ROWS]))).alias("rows"))

    def padded(c: Column) -> Column:
        return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(CELL) - F.length(c))))

    def across(label: str, fmt) -> Column:
        return F.concat(F.lit(label.ljust(LABEL_WIDTH)),
                        F.array_join(F.transform("rows", lambda r: padded(fmt(r))), ""))

    body = [across(KPI_ROWS[c][0], _cell(c))
            for c in R.QUARTER_COLUMNS if c in KPI_ROWS]
    blocks = per_year.select("year", _lit_lines([
        F.concat(F.lit("📅 "), F.col("year").cast("string")), MID_RULE, "",
        across("Type", lambda r: F.concat(F.lit("Q"), r["quarter"].cast("string"))), THIN_RULE,
        *body, ""]).alias("lines"))
    whole_text = blocks.agg(F.flatten(_many(blocks, "year", F.col("lines"))).alias("lines")).select(
        F.concat(_lit_lines([f"╔{BOX_EDGE}╗",
                             f"║          {company.upper()} - QUARTERLY KPI REPORT (ALL)",
                             f"╚{BOX_EDGE}╝", ""]), "lines",
                 _lit_lines([MID_RULE, f"Generated: {_stamp(as_of)}"])).alias("lines"))
    return whole_text.select(F.posexplode("lines").alias("line_no", "text")).select(
        (F.col("line_no") + 1).alias("line_no"), "text")
