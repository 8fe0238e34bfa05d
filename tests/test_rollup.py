"""Reports from stored sums against the same reports from the encounters."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions.exprs import MissingColumns
from tallymark.operators import denials as D
from tallymark.operators import metrics as M
from tallymark.plans import render, reports as R
from tallymark.plans.rollup import TOOL_SLICES, Rollup
from tallymark.session import stage_table
from tallymark.workloads import registry, views as V

AS_OF = "2001-08-01"


def rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()))


@pytest.fixture(scope="module")
def encounters(spark, sf_dir):
    return stage_table(V.encounters(spark, sf_dir), "encounters")


@pytest.fixture(scope="module")
def variants(spark, encounters):
    """Tables whose columns play the roles differently, each with its rollup."""
    e = encounters
    # Service dates with a time of day, another date for collections, rows without dates.
    timed = e.withColumn("visit_date", F.expr(
        "CASE WHEN visit_id % 11 <> 0 THEN visit_date + make_dt_interval(0, cast(visit_id % 24 AS INT)) END"))
    frames = {
        "plain": e,
        "timed": timed.withColumn("bill_date", F.expr("bill_date - INTERVAL 3 DAYS")),
        "years": e.withColumn("year", F.year("visit_created_date")),
        "quarters": timed.withColumn("year", F.year("visit_created_date")).withColumn(
            "quarter", F.quarter("visit_created_date")),
        "bare": e.select("visit_id", F.col("visit_date").alias("dos"), "charge", "total_payment"),
        "by status": V.status_filtered(e).drop("transaction_date", "balance"),
        "empty": e.limit(0),
    }
    return {n: (f, Rollup(f)) for n, f in frames.items()}


REPORTS = {
    "progress": R.billing_progress, "weekly": lambda e: R.weekly_kpis(e, AS_OF),
    "yearly": lambda e: R.yearly_kpis(e, AS_OF), "quarterly": lambda e: R.quarterly_kpis(e, AS_OF),
    "bounded": lambda e: R.quarterly_kpis(e, AS_OF, bounded=True),
    "billed": lambda e: R.quarterly_billed_ar(e, AS_OF), "breakdown": lambda e: R.weekly_breakdown(e, AS_OF),
    "given month": lambda e: R.weekly_breakdown(e, AS_OF, 1997, 5), "comparison": R.weekly_comparison,
    "month": R.month_to_date, "month as of": lambda e: R.month_to_date(e, "1998-05-17"),
    "unbilled": R.unbilled_status_week, "by label": lambda e: R.unbilled_status_week(e, by_label=True),
    "labels": R.week_labels, "denials": D.denial_top, "margins": D.denial_margins, "states": D.denial_states,
    "this month": lambda e: M.tool_total_charges(e, "current_month"),
    "net this month": lambda e: M.tool_net_collection_rate(e, "current_month"),
    "dated": lambda e: M.tool_total_visits(e, "other"), "gross": M.tool_gross_collection_rate,
    "days in ar": lambda e: M.tool_days_in_ar(e, AS_OF), "summary": lambda e: M.tool_ar_summary(e, AS_OF),
}


@pytest.mark.parametrize("table", ["plain", "timed", "years", "quarters", "bare", "by status", "empty"])
def test_reports_from_sums_equal_reports_from_rows(variants, table):
    frame, rollup = variants[table]
    for name, report in REPORTS.items():
        try:
            expected = rows(report(frame))
        except MissingColumns as missing:
            with pytest.raises(MissingColumns, match=str(missing).replace("(", r"\(").replace(")", r"\)")):
                report(rollup)
            continue
        assert rows(report(rollup)) == expected, name


def test_merged_halves_equal_the_whole(encounters, variants):
    halves = [Rollup(encounters.where(f"visit_id % 3 {op} 0")) for op in ("=", "<>")]
    merged = halves[0].merge(halves[1])
    whole = variants["plain"][1]
    held = [c for c in whole.table.columns]
    assert sorted(map(str, merged.table.select(*[F.col(f"`{c}`").cast("string") for c in held]).collect())) == \
        sorted(map(str, whole.table.select(*[F.col(f"`{c}`").cast("string") for c in held]).collect()))
    assert rows(render.report_lines(merged, "x", AS_OF)) == rows(render.report_lines(whole, "x", AS_OF))


def scans(df) -> list[str]:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "Relation [" in line]


def test_slides_read_only_the_rollup(variants):
    _, rollup = variants["plain"]
    for lines in (render.report_lines(rollup, "x", AS_OF), render.tool_answers(rollup, AS_OF)):
        assert scans(lines) and all("kind#" in s for s in scans(lines))


def test_the_view_is_read_once(spark, sf_dir, monkeypatch):
    """What is written while report_lines and tool_answers are made: each base table is read once."""
    from tallymark.plans import rollup as module

    written = []

    def recorded(df, label):
        written.append(scans(df))
        return stage_table(df, label)

    monkeypatch.setattr(registry, "stage_table", recorded)
    monkeypatch.setattr(module, "stage_table", recorded)
    for name in ("report_lines", "tool_answers"):
        written.clear()
        registry.QUERIES[name](spark, sf_dir)
        assert sum("l_extendedprice#" in s for frame in written for s in frame) == 1, name


def test_tools_keep_no_other_sums(encounters):
    rollup = Rollup(encounters, only=TOOL_SLICES)
    assert len(set(rollup.kinds.values())) == 1
    assert rows(render.tool_answers(rollup, AS_OF)) == rows(render.tool_answers(encounters, AS_OF))


def test_each_column_of_the_encounters_is_read_by_the_dates_that_need_it(encounters):
    """The billing date reads balances alone; no aggregation reads a column it does not sum."""
    rollup = Rollup(encounters)
    plan = rollup._sums(R.Encounters.of(encounters))._jdf.queryExecution().optimizedPlan().toString()
    narrow = [line for line in plan.split("\n") if "Project [" in line and "bill_date" in line]
    assert narrow and all("charge#" not in line and "cpt_code" not in line for line in narrow)
