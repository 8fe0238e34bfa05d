"""Reports on hand-made frames: period edges, calendars, missing inputs."""

import calendar
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymark.functions import exprs as X
from tallymark.functions.exprs import MissingColumns
from tallymark.operators import denials as D
from tallymark.plans import render
from tallymark.plans import reports as R


def day(y, m, d, h=0):
    return dt.datetime(y, m, d, h)


def week_numbers(year, month):
    """Plain restatement: a new week starts the day after every Monday."""
    number, out = 1, {}
    for d in range(1, calendar.monthrange(year, month)[1] + 1):
        out[d] = number
        if dt.date(year, month, d).weekday() == 0:
            number += 1
    return out


def test_tuesday_weeks_of_every_month(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1990-01-01', DATE'2040-12-31')) AS d")
    rows = days.select("d", X.tuesday_week(F.col("d")).alias("w")).collect()
    cache = {}
    for d, w in rows:
        key = (d.year, d.month)
        cache.setdefault(key, week_numbers(*key))
        assert cache[key][d.day] == w, d


def test_week_labels(spark):
    rows = [(dt.date(2024, 1, 1), "Jan 1st Week"), (dt.date(2024, 1, 8), "Jan 2nd Week"),
            (dt.date(2024, 1, 15), "Jan 3rd Week"), (dt.date(2024, 1, 29), "Jan 5th Week")]
    got = spark.createDataFrame(rows, "m date, want string").select(
        X.week_label(F.col("m")).alias("got"), "want").collect()
    assert all(g == w for g, w in got)


def test_year_ar_ends_at_midnight_of_december_31(spark):
    rows = [(day(2022, 12, 31, 0), "Claim Created", 1.0), (day(2022, 12, 31, 5), "Claim Created", 2.0),
            (day(2023, 3, 1), None, 4.0), (day(2023, 7, 2), "On Hold", 8.0),
            (day(2024, 1, 1), "Claim Created", 16.0)]
    df = spark.createDataFrame(rows, "visit_date timestamp_ntz, visit_status string, balance double")
    got = {r["year"]: (r["billed_ar"], r["unbilled_ar"])
           for r in R.yearly_kpis(df, "2023-07-01").collect()}
    assert got == {2022: (1.0, 0.0), 2023: (0.0, 4.0), 2024: (0.0, 0.0)}


def test_year_column_wins_if_half_valid_and_ar_follows_the_date(spark):
    rows = [(day(2022, 5, 1), 2021, "Claim Created", 1.0), (day(2022, 6, 1), None, "x", 2.0),
            (day(2021, 6, 1), 2021, "Claim Created", 4.0)]
    schema = "visit_date timestamp_ntz, year int, visit_status string, balance double"
    got = R.yearly_kpis(spark.createDataFrame(rows, schema), "2024-01-01").collect()
    assert [(r["year"], r["visits"], r["billed_ar"]) for r in got] == [(2021, 2, 4.0)]
    rows = [(d, None, s, b) for d, _, s, b in rows[:2]] + rows[2:]
    got = R.yearly_kpis(spark.createDataFrame(rows, schema), "2024-01-01").collect()
    assert {(r["year"], r["visits"], r["billed_ar"]) for r in got} == {(2022, 2, 1.0), (2021, 1, 4.0)}


def test_quarter_ar_runs_to_today(spark):
    rows = [(day(2023, 2, 1), "Claim Created", 1.0), (day(2023, 5, 1), "claim created ", 2.0),
            (day(2023, 8, 1), None, 4.0), (day(2023, 12, 1), "Claim Created", 8.0)]
    df = spark.createDataFrame(rows, "visit_date timestamp_ntz, visit_status string, balance double")
    got = {r["quarter"]: (r["billed_ar"], r["unbilled_ar"])
           for r in R.quarterly_kpis(df, "2023-09-01").collect()}
    assert got == {1: (3.0, 4.0), 2: (2.0, 4.0), 3: (0.0, 4.0), 4: (0.0, 0.0)}
    bounded = {r["quarter"]: r["billed_ar"]
               for r in R.quarterly_kpis(df, "2023-09-01", bounded=True).collect()}
    assert bounded == {1: 1.0, 2: 2.0, 3: 0.0, 4: 0.0}


def test_quarter_columns_may_name_quarters_without_service_dates(spark):
    rows = [(day(2023, 8, 1), 2023, 1, "Claim Created", 5.0)]
    schema = "visit_date timestamp_ntz, year int, quarter int, visit_status string, balance double"
    got = R.quarterly_kpis(spark.createDataFrame(rows, schema), "2024-01-01").collect()
    assert [(r["year"], r["quarter"], r["billed_ar"]) for r in got] == [(2023, 1, 5.0)]


def test_leap_year_and_current_period_days(spark):
    rows = [(day(2024, 2, 29), 366.0, 1.0), (day(2023, 5, 1), 365.0, 1.0)]
    df = spark.createDataFrame(rows, "visit_date timestamp_ntz, charge double, balance double")
    got = {r["year"]: r["days_in_ar"] for r in R.yearly_kpis(df, "2025-01-10").collect()}
    assert got == {2024: 1, 2023: 1}
    quarter = R.quarterly_kpis(df.filter("year(visit_date) = 2024"), "2025-01-10").first()
    assert quarter["days_in_ar"] == 1


def test_billing_progress_counts_a_row_in_both_lists(spark):
    rows = [(day(2024, 3, 1, 9), 10.0, "Pending Payment Received", 1.0, None),
            (day(2024, 3, 1, 7), 99.0, "Unpaid", 1.0, 1.0), (day(2024, 3, 5, 8), -4.0, "Unpaid", 2.0, 3.0),
            (day(2024, 2, 28), 50.0, "Completed", 9.0, 9.0)]
    df = spark.createDataFrame(rows, "visit_date timestamp_ntz, charge double, claim_status string, "
                                     "primary_payment double, patient_payment double")
    got = R.billing_progress(df).first()
    assert tuple(got) == ("March 2024", 10.0, 2, 3.0, 3.0, 2, 1)


def test_month_to_date_caps_days_and_lists_empty_months(spark):
    rows = [(day(2024, 3, 31), 1.0), (day(2024, 2, 29), 2.0), (day(2024, 1, 31), 4.0),
            (day(2024, 2, 29, 3), 8.0)]
    df = spark.createDataFrame(rows, "visit_date timestamp_ntz, charge double")
    got = {r["months_back"]: (r["month_label"], r["charges"], r["visits"])
           for r in R.month_to_date(df).collect()}
    assert got == {0: ("Mar 01 - Mar 31, 2024", 1.0, 1), 1: ("Feb 01 - Feb 29, 2024", 2.0, 1),
                   2: ("Jan 01 - Jan 31, 2024", 4.0, 1), 3: ("Dec 01 - Dec 31, 2023", 0.0, 0)}


def test_weekly_comparison_separates_service_and_transaction_dates(spark):
    rows = [(day(2024, 3, 10), day(2024, 4, 1), 10.0, 1.0), (day(2024, 3, 1), day(2024, 3, 9), 20.0, 2.0),
            (day(2024, 3, 4), None, 40.0, 4.0)]
    df = spark.createDataFrame(
        rows, "visit_date timestamp_ntz, transaction_date timestamp_ntz, charge double, total_payment double")
    got = R.weekly_comparison(df).first()
    assert (got["week_start"], got["week_end"]) == ("03/04/2024", "03/10/2024")
    assert (got["charges_dos"], got["collections_dos"], got["visits_dos"]) == (50.0, 2.0, 2)
    no_transactions = R.weekly_comparison(df.drop("transaction_date")).first()
    assert no_transactions["collections_dc"] == 5.0


def test_weekly_breakdown_is_cumulative(spark):
    created = [day(2024, 1, 10), day(2024, 2, 10), day(2024, 3, 10), day(2024, 4, 1), day(2024, 4, 2),
               day(2024, 4, 9), day(2024, 4, 8, 6)]
    df = spark.createDataFrame([(c, 91.0) for c in created],
                               "visit_created_date timestamp_ntz, total_payment double")
    got = R.weekly_breakdown(df).orderBy("week").collect()
    assert [r["actual_visits"] for r in got] == [1, 2, 3, 3, 3, 3]  # Monday 06:00 counts nowhere
    assert [r["days"] for r in got] == [1, 7, 7, 7, 7, 1]
    assert got[0]["forecasted_collections"] == pytest.approx(3.0)
    assert got[-1]["forecasted_visits"] == round(3 / 91 * 30)
    assert R.weekly_breakdown(df, year=2024, month=2).count() == 5


def test_weekly_breakdown_without_created_date(spark):
    df = spark.createDataFrame([(day(2024, 2, 10),)], "visit_date timestamp_ntz")
    rows = R.weekly_breakdown(df).collect()
    assert len(rows) == 5 and {r["actual_visits"] for r in rows} == {None}
    text = render.report_text(render.report_lines(df, "acme", "2024-03-01", slides=(6,)))
    assert "| Week 1 | visit created date not available | visit created date not available |" in text


def test_unbilled_week_by_date_and_by_label(spark):
    rows = [(day(2024, 3, 6), "On Hold"), (day(2024, 3, 10, 20), "ALERT"), (day(2024, 3, 12), "Other"),
            (day(2024, 3, 5), None), (day(2024, 3, 7), "Claim Created"), (day(2023, 3, 8), "On Hold")]
    df = spark.createDataFrame(rows, "visit_date timestamp_ntz, visit_status string")
    got = {r["status"]: r["visits"] for r in R.unbilled_status_week(df).collect()}
    assert (got["On Hold"], got["Alert"], got["Approved"], got["Total"]) == (1, 1, 0, 3)
    labelled = {r["status"]: r["visits"] for r in R.unbilled_status_week(df, by_label=True).collect()}
    assert (labelled["On Hold"], labelled["Total"]) == (2, 4)


def test_denials_ties_prefixes_and_null_states(spark):
    rows = [(f"C-{i:02d}: text {i}", "A", 1.0, 1) for i in range(16)] * 2
    rows += [("PR-10: x", "A", 1.0, 1), ("co45", "A", 1.0, 1), ("  C-15:   more   text ", None, None, 1),
             ("", "A", 1.0, 1), (None, "A", 1.0, 1), ("NaN", "A", 1.0, 1)]
    df = spark.createDataFrame(rows, "code_description string, state string, expected double, visit_id int")
    top = D.denial_top(df).collect()
    assert [r["code"] for r in top] == ["C-15"] + [f"C-{i:02d}" for i in range(14)]
    assert top[0]["sample_description"] == "C-15: more text" and top[0]["total_visits"] == 3
    margins = {(r["level"], r["label"]): r["visit_count"] for r in D.denial_margins(df).collect()}
    assert margins[("category", "C-15")] == 3
    assert margins[("state", "A")] == 30 and margins[("grand", None)] == 31
    assert ("state", None) not in margins
    assert [r[0] for r in D.denial_states(df).collect()] == ["A"]


def test_missing_columns_raise_and_render_as_errors(spark):
    df = spark.createDataFrame([(1.0,)], "charge double")
    for build in (R.billing_progress, R.yearly_kpis, R.quarterly_kpis, R.weekly_comparison,
                  R.month_to_date, R.unbilled_status_week, D.denial_totals):
        with pytest.raises(MissingColumns):
            build(df)
    text = render.report_text(render.report_lines(df, "acme", "2024-03-01"))
    assert "## SLIDE 3: ACME - KPI METRICS WEEKLY" in text and "| Charges | $1.00 |" in text
    assert "## ACME - BILLING PROGRESS (Current Month)\n\nError: No date field found in data." in text
    assert text.count("❌") == 6


def test_empty_table_renders_errors_per_slide(spark):
    schema = ("visit_date timestamp_ntz, visit_created_date timestamp_ntz, visit_status string, "
              "charge double, code_description string, state string, expected double")
    text = render.report_text(render.report_lines(spark.createDataFrame([], schema), "acme", "2024-03-01"))
    assert "❌ Error: No valid dates found in data." in text
    assert "No valid dates found in Visit Created Date column." in text
    assert "No denial data found" in text and "No data after filtering" in text


def test_report_file_keeps_the_order(spark, tmp_path):
    df = spark.createDataFrame([(1.0,)], "charge double")
    lines = render.report_lines(df, "acme", "2024-03-01", slides=(3, 2))
    render.write_report(lines, str(tmp_path / "report"))
    got = [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert got[0] == "## ACME - BILLING PROGRESS (Current Month)" and got[3].startswith("## SLIDE 3")


def test_tool_answers(spark):
    df = spark.createDataFrame([(1234.5, 10.0), (-4.0, 2.0)], "charge double, balance double")
    got = {r["tool"]: r["answer"] for r in render.tool_answers(df, "2024-03-01").collect()}
    assert got["get_total_charges"] == "**Total Charges:** $1,234.50"
    assert got["get_net_collection_rate"] == "❌ Required columns not found in data."
    assert got["get_ar_summary"] == "**AR Summary:**\n- Total AR: $12.00"
