"""KPI formulas on hand-made frames: fallbacks, nulls, edges."""

import datetime as dt
import math
import random

import pytest

from tallymark.functions import exprs as X
from tallymark.functions.exprs import Encounters, MissingColumns
from tallymark.functions.roles import CANDIDATES, resolve
from tallymark.operators import metrics as M

AS_OF = "2024-06-30"


def one(spark, rows, schema, *build):
    e = Encounters(spark.createDataFrame(rows, schema))
    return M.evaluate(e.df, [b(e) for b in build]).first().asDict()


def test_first_candidate_wins_and_contexts_differ():
    columns = ["total_charge", "total_charges", "payments", "collections"]
    assert resolve(columns, "charge", "total") == "total_charges"
    assert resolve(columns, "charge", "filtered") == "total_charge"
    assert resolve(["collection"], "payment", "total") is None
    assert resolve(["collection"], "payment", "filtered") == "collection"
    assert all(CANDIDATES.values())


def test_headers_are_normalised(spark):
    got = one(spark, [(5.0,), (-2.0,)], "` Charge ` double", M.total_charges)
    assert got == {"charges": 5.0}


def test_visits_prefer_counter_then_status_then_rows(spark):
    rows = [(2, "a"), (3, None)]
    assert one(spark, rows, "visits int, visit_status string", M.total_visits)["visits"] == 5
    assert one(spark, rows, "n int, visit_status string", M.total_visits)["visits"] == 1
    assert one(spark, rows, "n int, s string", M.total_visits)["visits"] == 2


def test_no_known_columns_and_empty_table(spark):
    builds = (M.total_charges, M.total_payments, M.charges_submitted_pct, M.gross_collection_rate,
              M.net_collection_rate, M.days_in_ar, M.billed_ar, M.unbilled_ar,
              lambda e: M.ar_31_60(e, AS_OF), lambda e: M.days_in_ar_weekly(e, AS_OF))
    for rows in ([(1,)], []):
        got = one(spark, rows, "x int", *builds)
        assert got.pop("charges_submitted_pct") == 100.0
        assert set(got.values()) == {0.0} or set(got.values()) == {0}
    schema = "visit_date timestamp_ntz, charge double, balance double, visit_status string"
    empty = one(spark, [], schema, *builds)
    assert all(v == 0 for v in empty.values())


def test_filters_keep_nulls(spark):
    schema = "status int, cpt_code string, transaction_type int, charge double, total_payment double"
    rows = [(12, "99214", 1, 1.0, 1.0), (None, "99214", 1, 2.0, 2.0), (3, None, None, 4.0, 4.0),
            (3, "90221", 1, 8.0, 8.0), (3, "99214", 9, 16.0, 16.0), (3, "99214", 10, -32.0, 32.0)]
    got = one(spark, rows, schema, M.filtered_charges, M.filtered_payments)
    assert got == {"filtered_charges": 22.0, "filtered_payments": 6.0}


def test_text_status_and_type_filters(spark):
    schema = "status string, transaction_type string, charge double, total_payment double"
    rows = [("12", "1", 1.0, 1.0), ("ok", "9", 2.0, 2.0), (None, None, 4.0, 4.0)]
    got = one(spark, rows, schema, M.filtered_charges, M.filtered_payments)
    assert got == {"filtered_charges": 6.0, "filtered_payments": 4.0}


def test_filtered_charges_fall_back_to_unit_times_amount(spark):
    rows = [("2", "10.5"), ("x", "3"), (None, "4"), ("1", "-7")]
    got = one(spark, rows, "units string, price string", M.filtered_charges)
    assert got["filtered_charges"] == 21.0


def test_narrow_units_and_amounts_do_not_overflow(spark):
    got = one(spark, [(120, 120)], "unit tinyint, amount tinyint", M.filtered_charges)
    assert got["filtered_charges"] == 14400.0
    got = one(spark, [(2_000_000_000, 2_000_000_000)], "unit int, amount int", M.filtered_charges)
    assert got["filtered_charges"] == 4e18


def test_submitted_share_matches_within_words(spark):
    rows = [("Unbilled", 10.0), ("claim created", 30.0), (None, 60.0), ("Billed", -5.0)]
    got = one(spark, rows, "visit_status string, charge double", M.charges_submitted_pct)
    assert got["charges_submitted_pct"] == pytest.approx(40.0)
    strict = one(spark, rows, "visit_status string, charge double",
                 lambda e: M.charges_submitted_pct(e, strict=True))
    assert strict["charges_submitted_pct"] == pytest.approx(30.0)


def test_submitted_share_fallbacks(spark):
    assert one(spark, [("billed",), ("x",)], "label string",
               M.charges_submitted_pct)["charges_submitted_pct"] == 50.0
    assert one(spark, [(5.0, 20.0)], "charges_submitted double, charge double",
               M.charges_submitted_pct)["charges_submitted_pct"] == 25.0


def test_balance_of_zero_falls_back(spark):
    schema = "balance double, charge double, total_payment double"
    got = one(spark, [(5.0, 100.0, 40.0), (-5.0, 0.0, 0.0)], schema, M.ending_ar)
    assert got["ending_ar"] == 60.0


def test_days_in_ar_uses_span_and_rounds_up(spark):
    rows = [(dt.datetime(2024, 1, 1), 10.0, 7.0), (dt.datetime(2024, 1, 10), 10.0, 0.0)]
    schema = "visit_date timestamp_ntz, charge double, balance double"
    assert one(spark, rows, schema, M.days_in_ar)["days_in_ar"] == math.ceil(7 / (20 / 10))
    undated = [(None, 10.0, 7.0)]
    assert one(spark, undated, schema, M.days_in_ar)["days_in_ar"] == 0


def test_weekly_period_is_year_to_date_only_within_this_year(spark):
    schema = "visit_date timestamp_ntz, charge double, balance double"
    inside = [(dt.datetime(2024, 2, 1), 366.0, 1.0)]
    got = one(spark, inside, schema, lambda e: M.days_in_ar_weekly(e, AS_OF))
    assert got["days_in_ar"] == math.ceil(1 / (366 / 182))
    across = inside + [(dt.datetime(2023, 12, 31), 0.0, 9.0)]
    got = one(spark, across, schema, lambda e: M.days_in_ar_weekly(e, AS_OF))
    assert got["days_in_ar"] == math.ceil(10 / (366 / 365))


def test_aging_buckets_share_day_sixty(spark):
    base = dt.datetime(2024, 6, 30)
    rows = [(base - dt.timedelta(days=d), 2.0 ** i)
            for i, d in enumerate((30, 31, 59, 60, 61, 90, 91))]
    got = one(spark, rows, "bill_date timestamp_ntz, balance double",
              lambda e: M.ar_31_60(e, AS_OF), lambda e: M.ar_60_plus(e, AS_OF))
    assert got == {"ar_31_60_days": 2.0 + 4 + 8, "ar_60_plus_days": 8.0 + 16 + 32}


def test_ages_are_floored_elapsed_days(spark):
    rows = [(dt.datetime(2024, 6, 29, 12), 1.0), (dt.datetime(2024, 6, 30, 1), 2.0)]
    e = Encounters(spark.createDataFrame(rows, "bill_date timestamp_ntz, balance double"))
    got = M.evaluate(e.df, M.ar_aging(e, "bill_date", "balance", [(0, 0), (-1, -1)], AS_OF)).first()
    assert tuple(got) == (1.0, 2.0)


def test_ready_buckets_win(spark):
    got = one(spark, [(3.0, 4.0)], "`ar_31_60` double, `AR 60+` double",
              lambda e: M.ar_31_60(e, AS_OF), lambda e: M.ar_60_plus(e, AS_OF))
    assert got == {"ar_31_60_days": 3.0, "ar_60_plus_days": 4.0}


def test_expected_falls_back_to_contractuals_then_charges(spark):
    assert one(spark, [(100.0, 30.0)], "charge double, contractual double",
               M.expected_payments)["expected"] == 70.0
    assert one(spark, [(100.0,)], "charge double", M.expected_payments)["expected"] == 100.0


def test_unbilled_falls_back_to_charges_beyond_billed(spark):
    got = one(spark, [(100.0, 30.0)], "charge double, balance double", M.billed_ar, M.unbilled_ar)
    assert got == {"billed_ar": 30.0, "unbilled_ar": 70.0}


def test_forecast(spark):
    schema = "d timestamp_ntz, pay double"
    rows = [(dt.datetime(2024, 1, 1), 10.0), (dt.datetime(2024, 1, 4), -3.0)]
    assert one(spark, rows, schema, lambda e: M.forecast(e, "pay", "d", 8))["forecast"] == 20.0
    assert one(spark, rows, schema, lambda e: M.forecast(e, "visits", "d", 8))["forecast"] == 0.0
    assert one(spark, rows, schema, lambda e: M.forecast(e, "rows", "none", 3))["forecast"] == 3.0


def test_dates_are_read_from_text(spark):
    rows = [("2024-01-02",), ("1/3/2024",), ("01/04/2024 10:30",), ("later",), (None,)]
    e = Encounters(spark.createDataFrame(rows, "visit_date string"))
    got = [r[0] for r in e.df.select(e.time("visit_date")).collect()]
    assert got == [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3),
                   dt.datetime(2024, 1, 4, 10, 30), None, None]


def test_tools_report_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(MissingColumns):
        M.TOOLS["get_total_charges"](df)
    assert M.TOOLS["get_total_visits"](df).first()[0] == 1


def test_ar_summary_does_not_trim_statuses(spark):
    rows = [(" claim created", 1.0), ("Claim Created", 2.0), ("on hold", 4.0)]
    df = spark.createDataFrame(rows, "status string, balance double")
    got = M.TOOLS["get_ar_summary"](df).first()
    assert (got["billed_ar"], got["unbilled_ar"], got["ar_31_60"]) == (2.0, 4.0, None)


def test_current_month_filter_starts_at_the_latest_time_of_day(spark):
    rows = [(dt.datetime(2024, 5, 1, 8),), (dt.datetime(2024, 5, 1, 12),),
            (dt.datetime(2024, 5, 9, 10),), (None,)]
    df = spark.createDataFrame(rows, "visit_date timestamp_ntz")
    assert M.TOOLS["get_total_visits"](df, "current_month").first()[0] == 2
    assert M.TOOLS["get_total_visits"](df, "other").first()[0] == 3
    assert M.TOOLS["get_total_visits"](df).first()[0] == 4


def test_random_frames_against_plain_python(spark):
    rng = random.Random(7)
    statuses = ["Claim Created", " claim created ", "Unbilled", "On Hold", None, "Alert"]
    for _ in range(3):
        rows = [(rng.choice(statuses), rng.choice([None, rng.randint(-50, 100)]),
                 rng.choice([None, rng.randint(0, 60)]), rng.choice([None, rng.randint(-20, 20)]))
                for _ in range(60)]
        got = one(spark, rows, "visit_status string, charge int, total_payment int, balance int",
                  M.total_charges, M.total_payments, M.charges_submitted_pct, M.billed_ar,
                  M.unbilled_ar, M.gross_collection_rate)
        charges = sum(c for _, c, _, _ in rows if c and c > 0)
        paid = sum(p or 0 for _, _, p, _ in rows)
        sent = sum(c for s, c, _, _ in rows if c and c > 0 and s
                   and any(w in s.lower() for w in X.SUBMITTED_WORDS))
        clean = lambda s: (s or "").strip().lower()
        assert got["charges"] == charges and got["payments"] == paid
        assert got["charges_submitted_pct"] == pytest.approx(sent / charges * 100)
        assert got["gross_collection_rate_pct"] == pytest.approx(paid / charges * 100)
        assert got["billed_ar"] == sum(b or 0 for s, _, _, b in rows if clean(s) in X.BILLED)
        assert got["unbilled_ar"] == sum(b or 0 for s, _, _, b in rows if clean(s) in X.UNBILLED)
