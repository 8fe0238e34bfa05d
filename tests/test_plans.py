"""What the physical plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from tallymark import session
from tallymark.operators import denials as D
from tallymark.operators import history as H
from tallymark.operators import metrics as M
from tallymark.operators import star
from tallymark.plans import reports as R
from tallymark.session import stage_table
from tallymark.workloads import registry, views as V

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "MapInArrow", "PythonUDTF")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def initial(plan: str) -> str:
    return plan.split("== Initial Plan ==")[-1]


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    return stage_table(V.encounters(spark, sf_dir), "encounters")


@pytest.mark.parametrize("build", [
    lambda e: R.weekly_kpis(e, "2001-08-01"), lambda e: R.yearly_kpis(e, "2001-08-01"),
    lambda e: R.quarterly_kpis(e, "2001-08-01"), D.denial_top, D.denial_margins,
    lambda e: M.TOOLS["get_ar_summary"](e, "2001-08-01")])
def test_reports_scan_once(staged, build):
    assert initial(plan_of(build(staged))).count("FileScan") == 1


def test_only_needed_columns_are_read(staged):
    plan = plan_of(R.billing_progress(staged))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert all("cpt_code" not in s and "expected" not in s for s in schemas)
    assert "visit_date:timestamp_ntz" in schemas[-1].split(",")[0] or len(schemas) >= 2


def test_no_cross_join_and_no_python(spark, sf_dir):
    for name, query in registry.QUERIES.items():
        if name in ("rate_breach_stream", "ingest_csv", "ingest_sheets", "report_lines", "profile_sink",
                    "provenance_recent", "sink_parquet", "narrow_cast"):
            continue  # these write files first
        plan = plan_of(query(spark, sf_dir))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert not any(node in plan for node in PYTHON_NODES), name


def test_history_limits_before_the_shuffle(spark, sf_dir):
    plan = plan_of(H.chat_history(V.table(spark, sf_dir, "conversations")))
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning")


def test_denial_patterns_run_after_the_first_grouping(staged):
    plan = initial(plan_of(D.denial_top(staged)))
    scan_side = plan[plan.rindex("Exchange"):]
    assert "regexp_replace" not in scan_side and "RLIKE" not in scan_side


def test_date_presets_meet_visits_before_lines_are_summed(spark, sf_dir):
    plan = star.charges_in(V.star(spark, sf_dir), "week", "2001-08-01")._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    assert text.rindex("Aggregate") < text.index("Join")


def test_steps_by_key_run_in_small_tasks(spark):
    """Keys of 8 bytes and more: Spark's own 64 MB would put them all into one task."""
    keys = spark.range(2_000_000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b"))
    rows = keys.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    with session.settings(spark, {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}):
        usual = len(session.stage_table(rows, "usual").inputFiles())
        small = session.stage_table(rows, "small", small_tasks=True)
    assert usual == 1 and len(small.inputFiles()) > 1
    assert small.count() == 2_000_000
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before


@pytest.mark.parametrize("build, label", [(star.payments_by_year, "payments-"), (star.lines_left_payments, "left_payments-")])
def test_payments_per_line_are_summed_in_small_tasks(spark, sf_dir, monkeypatch, build, label):
    asked = []
    def staged(df, name, small_tasks=False):
        asked.append(small_tasks)
        return session.stage_table(df, name, small_tasks)
    monkeypatch.setattr(star, "stage_table", staged, raising=False)
    assert label in build(V.star(spark, sf_dir)).inputFiles()[0]
    assert asked == [True]
