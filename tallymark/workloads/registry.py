"""Every registered query with its oracle SQL.

``QUERIES[name]`` takes (spark, sf_dir); ``ORACLE[name]`` is what DuckDB runs on
the same tables. A query without an entry in ``ORACLE`` has no SQL form.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import exprs as X
from tallymark.functions import names, text
from tallymark.functions.exprs import Encounters
from tallymark.operators import denials as D
from tallymark.operators import governance as G
from tallymark.operators import history as H
from tallymark.operators import metrics as M
from tallymark.operators import profile as P
from tallymark.operators import profile_states as PS
from tallymark.operators import star as S
from tallymark.operators.running import Running, running_totals
from tallymark.functions import sqltext as Q
from tallymark.plans import render
from tallymark.plans import reports as R
from tallymark.plans.rollup import TOOL_SLICES, Rollup
from tallymark.session import scratch_path, stage_table
from tallymark.sources import catalog as C
from tallymark.sources import readers, writers
from tallymark.streaming import provenance as daily
from tallymark.streaming import rates
from tallymark.workloads import logs as L
from tallymark.workloads import oracle_views as O
from tallymark.workloads import report_oracle
from tallymark.workloads import views as V
from tallymark.workloads.oracle_views import money, pct, with_

AS_OF = "2001-08-01"
MONTH_TO_DATE_AS_OF = "2001-07-18"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def enc(spark: SparkSession, sf: str) -> Encounters:
    return Encounters(V.encounters(spark, sf))


def enc_query(name: str, build: Callable[[Encounters], DataFrame], body: str) -> None:
    """A query over the encounter table, its oracle over the view ``enc``."""
    query(name, with_(O.ENCOUNTERS, body=body))(lambda spark, sf: build(enc(spark, sf)))


def metric_query(name: str, metrics: Callable[[Encounters], list], select: str) -> None:
    enc_query(name, lambda e: M.evaluate(e.df, metrics(e)), f"SELECT {select} FROM enc")


# --- whole-table KPIs ------------------------------------------------------------------

metric_query("total_visits", lambda e: [M.total_visits(e), M.row_count("row_visits")],
             "COUNT(visit_status) AS visits, COUNT(*) AS row_visits")
metric_query("total_charges", lambda e: [M.total_charges(e)], f"{O.CHARGES} AS charges")
metric_query("total_payments", lambda e: [M.total_payments(e), M.balance(e)],
             f"{O.PAYMENTS} AS payments, {O.BALANCE} AS balance")
metric_query("charges_submitted_pct", lambda e: [
    M.charges_submitted_pct(e),
    M.Metric("strict_pct", {f"{k}_strict": v for k, v in
                            M.charges_submitted_pct(e, strict=True).parts.items()},
             X.percent(F.col("_submitted_strict"), F.col("_submittable_strict")))],
    f"{O.SUBMITTED_PCT} AS charges_submitted_pct, " + pct(money(
        "charge", r"charge > 0 AND regexp_matches(lower(visit_status), "
                  r"'\b(claim created|submitted|billed)\b')"), O.CHARGES) + " AS strict_pct")
metric_query("charges_submitted_exact", lambda e: [M.charges_submitted_percentage(
    e, "charge", "visit_status", ["Claim Created", "Approved"])],
    pct(money("charge", "charge > 0 AND lower(visit_status) IN ('claim created', 'approved')"),
        O.CHARGES) + " AS charges_submitted_exact_pct")

_KEEP = f"{O.KEEP_STATUS} AND {O.KEEP_CPT}"
_KEEP_PAID = f"{O.KEEP_STATUS} AND {O.KEEP_CPT} AND {O.KEEP_TRANSACTION}"


def filtered_query(name: str, metrics, select: str, drop: tuple[str, ...] = ()) -> None:
    """KPIs over encounters whose only status column is the numeric one."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = Encounters(V.status_filtered(V.encounters(spark, sf)).drop(*drop))
        return M.evaluate(e.df, metrics(e))
    query(name, with_(O.ENCOUNTERS, body=f"SELECT {select} FROM enc"))(run)


filtered_query("filtered_charges", lambda e: [M.filtered_charges(e)],
               money("charge", f"charge > 0 AND {_KEEP}") + " AS filtered_charges")
filtered_query("filtered_payments", lambda e: [M.filtered_payments(e)],
               money("total_payment", _KEEP_PAID) + " AS filtered_payments")
_UNIT_AMOUNT = "COALESCE(unit, 0) * COALESCE(cpt_amount, 0)"
filtered_query("unit_amount_charges", lambda e: [M.filtered_charges(e)],
               money(_UNIT_AMOUNT, f"{_UNIT_AMOUNT} > 0 AND {_KEEP}") + " AS filtered_charges",
               drop=("charge",))
filtered_query("expected_filtered", lambda e: [M.expected_payments_filtered(e)],
               money("expected", _KEEP) + " AS expected_filtered")
metric_query("expected_payments", lambda e: [M.expected_payments(e)], f"{O.EXPECTED} AS expected")
metric_query("collection_rates",
             lambda e: [M.gross_collection_rate(e), M.net_collection_rate(e),
                        M.denial_resolution_rate()],
             f"{O.GCR} AS gross_collection_rate_pct, {O.NCR} AS net_collection_rate_pct, "
             "CAST(85 AS DOUBLE) AS denial_resolution_rate_pct")
metric_query("days_in_ar_auto", lambda e: [M.days_in_ar(e)],
             O.ar_days("greatest(date_diff('day', MIN(visit_date), MAX(visit_date)) + 1, 1)")
             + " AS days_in_ar")
_WEEKLY_PERIOD = (f"CASE WHEN year(MIN(visit_date)) = year(DATE '{AS_OF}') "
                  f"AND year(MAX(visit_date)) = year(DATE '{AS_OF}') "
                  f"THEN dayofyear(DATE '{AS_OF}') ELSE 365 END")
metric_query("days_in_ar_weekly", lambda e: [M.days_in_ar_weekly(e, AS_OF)],
             O.ar_days(_WEEKLY_PERIOD) + " AS days_in_ar")
_UNBILLED_LIST = ", ".join(f"'{s}'" for s in X.UNBILLED)
_BY_STATUS = "lower(trim(visit_status))"
_BILLED_SUM = money("balance", f"{_BY_STATUS} = 'claim created'")
_UNBILLED_SUM = money("balance", f"{_BY_STATUS} IN ({_UNBILLED_LIST})")


@query("billed_unbilled_ar", with_(O.ENCOUNTERS, body=f"""
SELECT b AS billed_ar, u AS unbilled_ar, {pct('b', '(b + u)')} AS billed_ar_pct,
  {pct('u', '(b + u)')} AS unbilled_ar_pct
FROM (SELECT {_BILLED_SUM} AS b, {_UNBILLED_SUM} AS u FROM enc)"""))
def billed_unbilled_ar(spark, sf):
    e = Encounters(V.encounters(spark, sf).drop("claim_status"))
    return M.evaluate(e.df, [M.billed_ar(e), M.unbilled_ar(e), M.billed_ar_pct(e),
                             M.unbilled_ar_pct(e)])


def _bucket(lo: int, hi: int, date: str = "bill_date") -> str:
    age = f"date_diff('day', {date}, TIMESTAMP '{AS_OF}')"
    return money("balance", f"{age} BETWEEN {lo} AND {hi}")


metric_query("ar_aging_bill_date", lambda e: [M.ar_31_60(e, AS_OF), M.ar_60_plus(e, AS_OF)],
             f"{_bucket(31, 60)} AS ar_31_60_days, {_bucket(60, 90)} AS ar_60_plus_days")
_BUCKETS = [(0, 30), (31, 60), (60, 90), (0, 90), (91, 3650)]
metric_query("ar_aging_buckets",
             lambda e: M.ar_aging(e, "visit_date", "balance", _BUCKETS, AS_OF),
             ", ".join(f"{_bucket(lo, hi, 'visit_date')} AS ar_{lo}_{hi}" for lo, hi in _BUCKETS))


@query("aged_ar_first_date", with_(O.ENCOUNTERS, body=f"""
SELECT {_bucket(31, 120, 'transaction_date')} AS aged_ar FROM enc"""))
def aged_ar_first_date(spark, sf):
    e = enc(spark, sf)
    return M.evaluate(e.df, [M.aged_ar(e, 31, 120, AS_OF)])


_SPAN = "(date_diff('day', MIN(visit_date), MAX(visit_date)) + 1)"
metric_query("forecast_payments", lambda e: [M.forecast(e, "total_payment", "visit_date", 30)],
             f"{money('total_payment', 'total_payment > 0')} / {_SPAN} * 30.0 AS forecast")
metric_query("forecast_visits", lambda e: [
    M.forecast(e, "rows", "visit_date", 30),
    M.Metric("without_column", M.forecast(e, "visits", "visit_date", 30).parts,
             M.forecast(e, "visits", "visit_date", 30).value())],
    f"CAST(COUNT(*) AS DOUBLE) / {_SPAN} * 30.0 AS forecast, CAST(0 AS DOUBLE) AS without_column")
metric_query("date_range", lambda e: M.date_range(e, "visit_date"),
             f"MIN(visit_date) AS min_date, MAX(visit_date) AS max_date, {_SPAN} AS days")

# --- interactive tools -----------------------------------------------------------------

_THIS_MONTH = ("WHERE visit_date >= date_trunc('month', (SELECT MAX(visit_date) FROM enc)) "
               "AND visit_date <= (SELECT MAX(visit_date) FROM enc)")
enc_query("tool_visits_current_month", lambda e: M.TOOLS["get_total_visits"](e, "current_month"),
          f"SELECT COUNT(*) AS total_visits FROM enc {_THIS_MONTH}")
enc_query("tool_charges_current_month", lambda e: M.TOOLS["get_total_charges"](e, "current_month"),
          f"SELECT {O.CHARGES} AS total_charges FROM enc {_THIS_MONTH}")
enc_query("tool_gross_collection_rate", M.TOOLS["get_gross_collection_rate"],
          f"SELECT {O.PAYMENTS} AS total_payments, {O.CHARGES} AS total_charges, {O.GCR} AS gcr_pct "
          "FROM enc")
enc_query("tool_net_collection_rate", M.TOOLS["get_net_collection_rate"],
          f"SELECT {O.PAYMENTS} AS total_payments, {O.EXPECTED} AS total_expected, "
          f"{O.NCR} AS ncr_pct FROM enc")
enc_query("tool_days_in_ar", lambda e: M.TOOLS["get_days_in_ar"](e, AS_OF),
          f"SELECT {O.BALANCE} AS ending_ar, {O.CHARGES} AS total_charges, "
          f"CAST({_WEEKLY_PERIOD} AS BIGINT) AS period_days, "
          f"{O.ar_days(_WEEKLY_PERIOD)} AS days_in_ar FROM enc")


def _share(part: str) -> str:
    return f"CASE WHEN t > 0 THEN {pct(part, 't')} ELSE 0.0 END"


def _in(statuses) -> str:
    return ", ".join(f"'{s}'" for s in statuses)


enc_query("ar_summary", lambda e: M.TOOLS["get_ar_summary"](e, AS_OF), f"""
SELECT t AS total_ar, a AS ar_31_60, c AS ar_60_90, b AS billed_ar, {_share('b')} AS billed_ar_pct,
  u AS unbilled_ar, {_share('u')} AS unbilled_ar_pct
FROM (SELECT {O.BALANCE} AS t, {_bucket(31, 60, 'visit_date')} AS a,
  {_bucket(60, 90, 'visit_date')} AS c,
  {money('balance', f"lower(visit_status) IN ({_in(M.SUMMARY_BILLED)})")} AS b,
  {money('balance', f"lower(visit_status) IN ({_in(M.SUMMARY_UNBILLED)})")} AS u FROM enc)""")

# --- reports -----------------------------------------------------------------------------

_PERIOD_KPIS = f"""COUNT(visit_status) AS visits, {O.CHARGES} AS charges,
  ROUND({O.SUBMITTED_PCT}, 2) AS charges_submitted_pct, {O.PAYMENTS} AS payments,
  ROUND({O.GCR}, 2) AS gross_collection_rate_pct, ROUND({O.NCR}, 2) AS net_collection_rate_pct"""

_YEAR_END = (f"CASE WHEN year(visit_date) < year(DATE '{AS_OF}') "
             f"THEN CAST(make_date(year(visit_date), 12, 31) AS TIMESTAMP) "
             f"ELSE TIMESTAMP '{AS_OF}' END")

YEARLY_SQL = f"""
SELECT CAST(year(visit_date) AS INT) AS year, {_PERIOD_KPIS},
  {O.ar_days(f"CASE WHEN year(MIN(visit_date)) = year(DATE '{AS_OF}') THEN dayofyear(DATE '{AS_OF}') ELSE 365 END")} AS days_in_ar,
  {money('balance', f"{O.BILLED_FLAG} AND visit_date <= {_YEAR_END}")} AS billed_ar,
  {money('balance', f"NOT {O.BILLED_FLAG} AND visit_date <= {_YEAR_END}")} AS unbilled_ar,
  CAST(85 AS DOUBLE) AS denial_resolution_rate_pct
FROM enc GROUP BY year(visit_date)"""
enc_query("yearly_kpis", lambda e: R.yearly_kpis(e, AS_OF), YEARLY_SQL)

_QUARTER_START = "date_trunc('quarter', MIN(visit_date))"
_QUARTER_DAYS = (
    f"CASE WHEN year(MIN(visit_date)) = year(DATE '{AS_OF}') "
    f"AND quarter(MIN(visit_date)) = quarter(DATE '{AS_OF}') "
    f"THEN date_diff('day', CAST({_QUARTER_START} AS DATE), DATE '{AS_OF}') + 1 "
    f"ELSE date_diff('day', CAST({_QUARTER_START} AS DATE), "
    f"CAST({_QUARTER_START} + INTERVAL 3 MONTH AS DATE)) END")

# The definition, spelled as a range join: from each quarter's start to today.
_QUARTER_AR = f"""
qs AS (SELECT DISTINCT year(visit_date) AS y, quarter(visit_date) AS q,
         date_trunc('quarter', visit_date) AS s FROM enc),
qar AS (SELECT y, q,
    {money('balance', O.BILLED_FLAG)} AS billed_ar,
    {money('balance', f'NOT {O.BILLED_FLAG}')} AS unbilled_ar
  FROM qs LEFT JOIN enc ON visit_date >= s AND visit_date <= TIMESTAMP '{AS_OF}'
  GROUP BY y, q)"""

# An unmatched quarter keeps one all-null row on the right, which adds 0 to both sums.
_QUARTERLY_BODY = f"""
SELECT CAST(k.y AS INT) AS year, CAST(k.q AS INT) AS quarter, visits, charges,
  charges_submitted_pct, payments, gross_collection_rate_pct, net_collection_rate_pct, days_in_ar,
  billed_ar, ROUND(CASE WHEN billed_ar + unbilled_ar > 0
    THEN {pct('billed_ar', '(billed_ar + unbilled_ar)')} ELSE 0.0 END, 2) AS billed_ar_pct,
  unbilled_ar, ROUND(CASE WHEN billed_ar + unbilled_ar > 0
    THEN {pct('unbilled_ar', '(billed_ar + unbilled_ar)')} ELSE 0.0 END, 2) AS unbilled_ar_pct,
  CAST(85 AS DOUBLE) AS denial_resolution_rate_pct
FROM (SELECT year(visit_date) AS y, quarter(visit_date) AS q, {_PERIOD_KPIS},
        {O.ar_days(_QUARTER_DAYS)} AS days_in_ar
      FROM enc GROUP BY year(visit_date), quarter(visit_date)) k
  JOIN qar ON k.y = qar.y AND k.q = qar.q"""
query("quarterly_kpis", with_(O.ENCOUNTERS, _QUARTER_AR, body=_QUARTERLY_BODY))(
    lambda spark, sf: R.quarterly_kpis(enc(spark, sf), AS_OF))
query("latest_quarter", with_(O.ENCOUNTERS, _QUARTER_AR, body=(
    f"SELECT * FROM ({_QUARTERLY_BODY}) ORDER BY year DESC, quarter DESC LIMIT 1")))(
    lambda spark, sf: R.latest_quarter(R.quarterly_kpis(enc(spark, sf), AS_OF)))
query("quarterly_billed_ar", with_(O.ENCOUNTERS, _QUARTER_AR, body="""
SELECT CAST(y AS INT) AS year, CAST(q AS INT) AS quarter, billed_ar, unbilled_ar FROM qar"""))(
    lambda spark, sf: R.quarterly_billed_ar(enc(spark, sf), AS_OF))
enc_query("quarterly_billed_ar_bounded",
          lambda e: R.quarterly_billed_ar(e, AS_OF, bounded=True), f"""
SELECT CAST(year(visit_date) AS INT) AS year, CAST(quarter(visit_date) AS INT) AS quarter,
  {money('balance', f"{O.BILLED_FLAG} AND visit_date <= TIMESTAMP '{AS_OF}'")} AS billed_ar,
  {money('balance', f"NOT {O.BILLED_FLAG} AND visit_date <= TIMESTAMP '{AS_OF}'")} AS unbilled_ar
FROM enc GROUP BY year(visit_date), quarter(visit_date)""")


@query("yearly_kpis_year_column", with_(O.ENCOUNTERS, body=f"""
SELECT k.year, visits, charges, charges_submitted_pct, payments, gross_collection_rate_pct,
  net_collection_rate_pct, days_in_ar, COALESCE(billed_ar, 0.0) AS billed_ar,
  COALESCE(unbilled_ar, 0.0) AS unbilled_ar, CAST(85 AS DOUBLE) AS denial_resolution_rate_pct
FROM (SELECT CAST(year(visit_created_date) AS INT) AS year, {_PERIOD_KPIS},
    {O.ar_days(f"CASE WHEN year(MIN(visit_created_date)) = year(DATE '{AS_OF}') THEN dayofyear(DATE '{AS_OF}') ELSE 365 END")} AS days_in_ar
  FROM enc GROUP BY year(visit_created_date)) k
LEFT JOIN (SELECT CAST(year(visit_date) AS INT) AS year,
    {money('balance', f"{O.BILLED_FLAG} AND visit_date <= {_YEAR_END}")} AS billed_ar,
    {money('balance', f"NOT {O.BILLED_FLAG} AND visit_date <= {_YEAR_END}")} AS unbilled_ar
  FROM enc GROUP BY year(visit_date)) a ON k.year = a.year"""))
def yearly_kpis_year_column(spark, sf):
    """A ready-made year column that disagrees with the service date."""
    df = V.encounters(spark, sf).withColumn("year", F.year("visit_created_date"))
    return R.yearly_kpis(df, AS_OF)


enc_query("weekly_kpis", lambda e: R.weekly_kpis(e, AS_OF), f"""
SELECT {_PERIOD_KPIS}, {O.ar_days(_WEEKLY_PERIOD)} AS days_in_ar,
  {_bucket(31, 60)} AS ar_31_60_days, {_bucket(60, 90)} AS ar_60_plus_days,
  CAST(85 AS DOUBLE) AS denial_resolution_rate_pct FROM enc""")


def _has(words) -> str:
    return "COUNT(CASE WHEN regexp_matches(lower(trim(claim_status)), '%s') THEN 1 END)" % "|".join(words)


enc_query("billing_progress", R.billing_progress, f"""
SELECT strftime(MAX(visit_date), '%B %Y') AS month_label, {O.CHARGES} AS charges,
  COUNT(*) AS encounters, {money('primary_payment')} + {money('secondary_payment')}
    + {money('tertiary_payment')} AS insurance_payments,
  {money('patient_payment')} AS patient_payments, {_has(R.PROCESSED_WORDS)} AS ar_claims_processed,
  {_has(R.PENDING_WORDS)} AS auth_denials_pending FROM enc {_THIS_MONTH}""")

_MONTH_START = "CAST(date_trunc('month', MAX(visit_created_date)) AS DATE)"
BREAKDOWN_SQL = f"""
anchor AS (SELECT {_MONTH_START} AS m FROM enc),
days AS (SELECT m, CAST(unnest(generate_series(m, last_day(m), INTERVAL 1 DAY)) AS DATE) AS d FROM anchor),
numbered AS (SELECT m, d, CAST(1 + floor((date_diff('day',
    m + CAST((8 - isodow(m)) % 7 AS INT), d) + 6) / 7.0) AS INT) AS week FROM days),
weeks AS (SELECT m, week, MIN(d) AS s, MAX(d) AS e, COUNT(*) AS n FROM numbered GROUP BY m, week),
base AS (SELECT COUNT(visit_id) AS v, {money('total_payment', 'total_payment > 0')} AS p
  FROM anchor JOIN enc ON visit_created_date >= m - INTERVAL 3 MONTH AND visit_created_date < m),
acts AS (SELECT week, COUNT(visit_id) AS v, SUM(CASE WHEN total_payment > 0 THEN total_payment END) AS p
  FROM weeks LEFT JOIN enc ON visit_created_date >= s AND visit_created_date <= e GROUP BY week),
cum AS (SELECT w.m, w.week, w.s, w.e, w.n,
    SUM(w.n) OVER (ORDER BY w.week) AS cd, SUM(a.v) OVER (ORDER BY w.week) AS cv,
    COALESCE(CAST(SUM(a.p) OVER (ORDER BY w.week) AS DOUBLE), 0.0) AS cp,
    date_diff('day', CAST(w.m - INTERVAL 3 MONTH AS DATE), w.m) AS bd
  FROM weeks w JOIN acts a ON w.week = a.week)"""
query("weekly_breakdown", with_(O.ENCOUNTERS, BREAKDOWN_SQL, body="""
SELECT CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month, strftime(m, '%B') AS month_name,
  concat(strftime(m - INTERVAL 3 MONTH, '%Y-%m'), ' to ', strftime(m - INTERVAL 1 MONTH, '%Y-%m')) AS forecast_period,
  ROUND(CAST(base.v AS DOUBLE) / bd, 2) AS avg_daily_visits, ROUND(base.p / bd, 2) AS avg_daily_collections,
  week, strftime(s, '%Y-%m-%d') AS week_start, strftime(e, '%Y-%m-%d') AS week_end,
  CAST(n AS INT) AS days, CAST(round_even(CAST(base.v AS DOUBLE) / bd * cd, 0) AS BIGINT) AS forecasted_visits,
  CAST(cv AS BIGINT) AS actual_visits, ROUND(base.p / bd * cd, 2) AS forecasted_collections,
  ROUND(cp, 2) AS actual_collections FROM cum, base"""))(
    lambda spark, sf: R.weekly_breakdown(enc(spark, sf), AS_OF))
enc_query("forecast_base", R.forecast_base, f"""
SELECT strftime(date_trunc('month', visit_created_date), '%Y-%m') AS month,
  CAST(day(last_day(MIN(visit_created_date))) AS INT) AS days, COUNT(*) AS visits,
  {money('total_payment', 'total_payment > 0')} AS collections
FROM enc WHERE visit_created_date >= (SELECT {_MONTH_START} FROM enc) - INTERVAL 3 MONTH
  AND visit_created_date < (SELECT {_MONTH_START} FROM enc)
GROUP BY date_trunc('month', visit_created_date)""")


def _week_sql(keep: str) -> str:
    """Client week; ``keep`` is the status filter, which text statuses never trip."""
    kept, paid = f"{keep} AND {O.KEEP_CPT}", f"{keep} AND {O.KEEP_CPT} AND {O.KEEP_TRANSACTION}"
    return with_(O.ENCOUNTERS, body=f"""
SELECT strftime(b - INTERVAL 6 DAY, '%m/%d/%Y') AS week_start, strftime(b, '%m/%d/%Y') AS week_end,
  p AS collections_dos, p AS collections_dc, c AS charges_dos, c AS charges_dc,
  v AS visits_dos, v AS visits_dc
FROM (SELECT b, {money('total_payment', f"{paid} AND transaction_date BETWEEN b - INTERVAL 6 DAY AND b")} AS p,
    {money('charge', f"charge > 0 AND {kept} AND visit_date BETWEEN b - INTERVAL 6 DAY AND b")} AS c,
    COUNT(CASE WHEN visit_date BETWEEN b - INTERVAL 6 DAY AND b THEN 1 END) AS v
  FROM enc, (SELECT MAX(visit_date) AS b FROM enc) GROUP BY b)""")


@query("weekly_comparison", _week_sql(O.KEEP_STATUS))
def weekly_comparison(spark, sf):
    return R.weekly_comparison(V.status_filtered(V.encounters(spark, sf)))


_MTD_MONTH = "CAST(date_trunc('month', b) - to_months(CAST(k AS INT)) AS DATE)"


def _mtd_sql(rows: str) -> str:
    return with_(O.ENCOUNTERS, f"""
mtd AS ({rows}),
months AS (SELECT k, b, {_MTD_MONTH} AS m,
    least(day(b), day(last_day({_MTD_MONTH}))) AS d
  FROM range(4) t(k), (SELECT MAX(visit_date) AS b FROM mtd))""", body=f"""
SELECT CAST(k AS INT) AS months_back,
  concat(strftime(m, '%b %d'), ' - ', strftime(m + CAST(d - 1 AS INT), '%b %d, %Y')) AS month_label,
  strftime(m, '%B %Y') AS month_name, concat('1-', CAST(day(b) AS VARCHAR)) AS day_range,
  {money('total_payment', f"{O.KEEP_CPT} AND {O.KEEP_TRANSACTION}")} AS collections,
  {money('charge', f"charge > 0 AND {O.KEEP_CPT}")} AS charges, COUNT(visit_status) AS visits
FROM months LEFT JOIN mtd ON visit_date >= m AND visit_date <= m + CAST(d - 1 AS INT)
GROUP BY k, m, d, b""")


@query("mtd_comparison",
       _mtd_sql(f"SELECT * FROM enc WHERE visit_date <= TIMESTAMP '{MONTH_TO_DATE_AS_OF}'"))
def mtd_comparison(spark, sf):
    return R.month_to_date(V.encounters(spark, sf), MONTH_TO_DATE_AS_OF)


_NOT_BILLED = "COALESCE(lower(trim(visit_status)), '') <> 'claim created'"
_SUNDAY = ("(SELECT CAST(MAX(visit_date) AS DATE) - CAST(dayofweek(MAX(visit_date)) AS INT) "
           f"FROM enc WHERE {_NOT_BILLED})")
_WEEK_COUNTS = " UNION ALL ".join(
    [f"SELECT {i + 1} AS position, '{s}' AS status, "
     f"COUNT(CASE WHEN lower(trim(visit_status)) = '{s.lower()}' THEN 1 END) AS visits FROM wk"
     for i, s in enumerate(R.UNBILLED_REPORT_STATUSES)]
    + [f"SELECT {len(R.UNBILLED_REPORT_STATUSES) + 1}, 'Total', COUNT(*) FROM wk"])
_WEEK_LABEL_SQL = ("concat(strftime(mon, '%b'), ' ', CAST(nth AS VARCHAR), "
                   "CASE nth WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END, ' Week')")
query("unbilled_status_week", with_(O.ENCOUNTERS, f"""
sun AS (SELECT {_SUNDAY} AS s),
wk AS (SELECT enc.* FROM enc, sun WHERE {_NOT_BILLED} AND visit_date >= s - 6 AND visit_date < s + 1)""",
    body=f"""SELECT CAST(position AS INT) AS position, status,
  concat(strftime(s - 6, '%b %d'), ' - ', strftime(s, '%b %d')) AS week, visits
FROM ({_WEEK_COUNTS}) c, sun"""))(lambda spark, sf: R.unbilled_status_week(enc(spark, sf)))
query("unbilled_status_by_label", with_(O.ENCOUNTERS, f"""
sun AS (SELECT {_SUNDAY} AS s),
lab AS (SELECT *, CAST(date_trunc('week', visit_date) AS DATE) AS mon,
    CAST(floor((day(date_trunc('week', visit_date)) - 1) / 7) + 1 AS INT) AS nth FROM enc
  WHERE {_NOT_BILLED}),
tgt AS (SELECT {_WEEK_LABEL_SQL} AS label FROM (SELECT s - 6 AS mon,
    CAST(floor((day(s - 6) - 1) / 7) + 1 AS INT) AS nth FROM sun)),
wk AS (SELECT lab.* FROM lab, tgt WHERE {_WEEK_LABEL_SQL} = label)""",
    body=f"""SELECT CAST(position AS INT) AS position, status,
  concat(strftime(s - 6, '%b %d'), ' - ', strftime(s, '%b %d')) AS week, visits
FROM ({_WEEK_COUNTS}) c, sun"""))(
    lambda spark, sf: R.unbilled_status_week(enc(spark, sf), by_label=True))
enc_query("week_labels", R.week_labels, f"""
SELECT {_WEEK_LABEL_SQL} AS week_label, MIN(mon) AS first_monday, COUNT(*) AS visits
FROM (SELECT CAST(date_trunc('week', visit_date) AS DATE) AS mon,
    CAST(floor((day(date_trunc('week', visit_date)) - 1) / 7) + 1 AS INT) AS nth
  FROM enc WHERE {_NOT_BILLED}) GROUP BY 1""")

# --- denials ----------------------------------------------------------------------------

_PREFIXES = "|".join(D.EXCLUDED_PREFIXES)
DENIED_SQL = f"""
den AS (SELECT * FROM (SELECT trim(split_part(description, ':', 1)) AS code, description, state,
    expected, visit_id
  FROM (SELECT *, trim(regexp_replace(code_description, '\\s+', ' ', 'g')) AS description FROM enc
    WHERE code_description IS NOT NULL AND code_description <> ''
      AND lower(code_description) <> 'nan'))
  WHERE NOT regexp_matches(upper(code), '^({_PREFIXES})')),
tot AS (SELECT code, COUNT(visit_id) AS total_visits, {money('expected')} AS total_expected,
    MIN(description) AS sample_description FROM den GROUP BY code),
top AS (SELECT * FROM tot ORDER BY total_visits DESC, code LIMIT 15),
cells AS (SELECT * FROM den WHERE code IN (SELECT code FROM top))"""


def denial_query(name: str, build, body: str) -> None:
    query(name, with_(O.ENCOUNTERS, DENIED_SQL, body=body))(
        lambda spark, sf: build(enc(spark, sf)))


denial_query("denial_totals", D.denial_totals, "SELECT * FROM tot")
denial_query("denial_top15", D.denial_top, "SELECT * FROM top")
denial_query("denial_states", D.denial_states,
             "SELECT DISTINCT state FROM den WHERE state IS NOT NULL")
denial_query("denial_by_state", D.denial_by_state, f"""
SELECT code, state, COUNT(*) AS visit_count, {money('expected')} AS expected FROM cells
WHERE state IS NOT NULL GROUP BY code, state""")
denial_query("denial_state_totals", D.denial_state_totals, f"""
SELECT state, COUNT(*) AS visit_count, {money('expected')} AS expected FROM cells
WHERE state IS NOT NULL GROUP BY state""")
denial_query("denial_margins", D.denial_margins, f"""
SELECT 'category' AS level, code AS label, COUNT(*) AS visit_count, {money('expected')} AS expected
FROM cells GROUP BY code
UNION ALL SELECT 'state', state, COUNT(*), {money('expected')} FROM cells
WHERE state IS NOT NULL GROUP BY state
UNION ALL SELECT 'grand', NULL, COUNT(*), {money('expected')} FROM cells""")

# --- billing star schema -------------------------------------------------------------------


def star_query(name: str, build, body: str) -> None:
    query(name, with_(O.STAR, body=body))(lambda spark, sf: build(V.star(spark, sf)))


_LINES = """patient_visit pv JOIN patient_visit_cpt pvc ON pv.id = pvc.visit_id
    AND pvc.deleted_at IS NULL JOIN cpt_codes cc ON cc.id = pvc.cpt_id AND cc.deleted_at IS NULL"""
_STAR_WHERE = """pv.deleted_at IS NULL AND pv.status <> 12
  AND cc.cpt_code NOT IN ('00001', '00002', '00003', '90221', '90222')"""
_STAR_CHARGE = money("COALESCE(pvc.unit, 0) * COALESCE(pvc.cpt_amount, 0)")
star_query("star_charges", S.charges_by_year, f"""
SELECT CAST(year(pv.visit_date) AS INT) AS year, {_STAR_CHARGE} AS charges, COUNT(*) AS line_count
FROM {_LINES} WHERE {_STAR_WHERE} GROUP BY year(pv.visit_date)""")
star_query("star_payments", S.payments_by_year, f"""
SELECT CAST(year(pv.visit_date) AS INT) AS year, {money('p.amount')} AS payments,
  COUNT(*) AS payment_count
FROM {_LINES} JOIN payment p ON pvc.id = p.encounter_id
WHERE {_STAR_WHERE} AND p.deleted_at IS NULL AND p.transaction_type NOT IN (9, 10)
GROUP BY year(pv.visit_date)""")
star_query("star_payments_left", S.lines_left_payments, f"""
SELECT CAST(year(pv.visit_date) AS INT) AS year, COUNT(*) AS line_count,
  COUNT(p.encounter_id) AS paid_lines, {money('p.amount')} AS payments
FROM patient_visit pv JOIN patient_visit_cpt pvc ON pv.id = pvc.visit_id AND pvc.deleted_at IS NULL
LEFT JOIN payment p ON pvc.id = p.encounter_id AND p.deleted_at IS NULL
  AND p.transaction_type NOT IN (9, 10)
WHERE pv.deleted_at IS NULL AND pv.status <> 12 GROUP BY year(pv.visit_date)""")
star_query("star_visits_by_status", S.visits_by_status, """
SELECT vs.name AS status_name, COUNT(*) AS visit_count FROM patient_visit pv
JOIN visit_status vs ON pv.status = vs.id WHERE pv.deleted_at IS NULL GROUP BY vs.name""")

_PRESETS = {
    "month": f"CAST(visit_date AS DATE) >= date_trunc('month', DATE '{AS_OF}') "
             f"AND CAST(visit_date AS DATE) <= last_day(DATE '{AS_OF}')",
    "quarter": f"year(visit_date) = year(DATE '{AS_OF}') AND quarter(visit_date) = quarter(DATE '{AS_OF}')",
    "year": f"year(visit_date) = year(DATE '{AS_OF}')",
    "week": f"CAST(visit_date AS DATE) >= DATE '{AS_OF}' - 7 AND CAST(visit_date AS DATE) <= DATE '{AS_OF}'",
}
for _preset, _where in _PRESETS.items():
    star_query(f"date_preset_{_preset}", lambda st, p=_preset: S.charges_in(st, p, AS_OF), f"""
SELECT COUNT(DISTINCT pv.id) AS visit_count, COUNT(*) AS line_count, {_STAR_CHARGE} AS charges
FROM {_LINES} WHERE {_STAR_WHERE} AND {_where}""")

# --- sources, sinks and catalog ---------------------------------------------------------------


@query("scan_parquet", "SELECT o_orderstatus, COUNT(*) AS order_count, "
                       "CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total_price "
                       "FROM orders GROUP BY o_orderstatus")
def scan_parquet(spark, sf):
    view = readers.register_parquet(spark, f"{sf.rstrip('/')}/orders.parquet", "scan-orders")
    return spark.sql(
        "SELECT o_orderstatus, COUNT(*) AS order_count, "
        f"CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total_price FROM {view} "
        "GROUP BY o_orderstatus")


@query("ingest_csv", """
SELECT o_orderkey AS order_key, o_custkey AS cust_no, o_orderstatus AS col_1st_status,
  o_totalprice AS total_price, o_orderdate AS order_date, o_orderpriority AS priority FROM orders""")
def ingest_csv(spark, sf):
    """Orders written as text under awkward headers, ingested, and read back."""
    raw, out = scratch_path(spark, "csv"), scratch_path(spark, "ingested")
    V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order key"), F.col("o_custkey").alias("cust-no."),
        F.col("o_orderstatus").alias("1st status"), F.col("o_totalprice").alias("total (price)"),
        F.col("o_orderdate").alias("order/date"), F.col("o_orderpriority").alias(" priority "),
    ).write.option("header", True).csv(raw)
    readers.ingest_csv(spark, raw, out)
    return spark.read.parquet(out)


@query("ingest_reordered", """
SELECT o_orderkey AS order_key, o_custkey AS cust_no, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS note,
  CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice END AS total,
  (SELECT COUNT(*) FROM orders WHERE o_orderkey % 7 = 0) AS quarantined
FROM orders WHERE o_orderkey % 7 <> 0""")
def ingest_reordered(spark, sf):
    """Three uploads whose headers differ in order and columns; rows with a cell too many are set aside."""
    raw, out, aside = (scratch_path(spark, n) for n in ("uploads", "ingested", "aside"))
    key = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.col("o_orderkey"), F.lit(",9"))).otherwise(
        F.col("o_orderkey").cast("string")).alias("order key")
    cust, total = F.col("o_custkey").alias("cust-no."), F.col("o_totalprice").alias("total")
    note = F.col("o_orderpriority").alias("note")
    for i, columns in enumerate(((key, cust, total), (note, cust, key), (total, note, key, cust))):
        V.table(spark, sf, "orders").filter(F.col("o_orderkey") % 3 == i).select(*columns).write.option(
            "header", True).option("quote", "").csv(f"{raw}/{i}")
    readers.ingest_csv(spark, raw, out, rescued=aside)
    set_aside = spark.read.parquet(aside).agg(F.count("line")).scalar()
    return spark.read.parquet(out).select("order_key", "cust_no", "note", "total", set_aside.alias("quarantined"))


@query("ingest_sheets", """
SELECT 'customers_2024' AS table_name, COUNT(*) AS row_count, 3 AS column_count,
  CAST(SUM(c_custkey) AS BIGINT) AS key_sum FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'parts', COUNT(*), 3, CAST(SUM(p_partkey) AS BIGINT) FROM part""")
def ingest_sheets(spark, sf):
    """Two exported sheets with empty rows and repeated headers; a third is empty."""
    folder, out = scratch_path(spark, "sheets"), scratch_path(spark, "tables")
    blank = F.col("c_acctbal") < 0
    customer = V.table(spark, sf, "customer").select(*[
        F.when(~blank, F.col(c)).alias(n) for c, n in (
            ("c_custkey", "Key No."), ("c_name", "Name"), ("c_mktsegment", "Segment (US)"))])
    customer.write.option("header", True).csv(f"{folder}/Customers 2024.csv")
    V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("Key No."), F.col("p_name").alias("Name"),
        F.col("p_type").alias("name")).write.option("header", True).csv(f"{folder}/Parts.csv")
    V.table(spark, sf, "part").filter(F.lit(False)).select("p_partkey").write.option(
        "header", True).csv(f"{folder}/Empty.csv")
    sheets = readers.ingest_sheets(spark, folder, out)
    parts = [spark.read.parquet(s["parquet_path"]).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("key_no_").cast("bigint").alias("key_sum"))
        .select(F.lit(s["table_name"]).alias("table_name"), "row_count",
                F.lit(s["column_count"]).alias("column_count"), "key_sum") for s in sheets]
    out_df = parts[0]
    for part in parts[1:]:
        out_df = out_df.unionByName(part)
    return out_df


@query("sink_parquet", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def sink_parquet(spark, sf):
    out = scratch_path(spark, "sink")
    writers.write_parquet(
        V.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"),
        out, partition_by=("c_mktsegment",))
    return spark.read.parquet(out).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


query("table_info", """
SELECT 'orders' AS table_name, (SELECT COUNT(*) FROM orders) AS row_count,
  CAST(6 AS BIGINT) AS column_count, * FROM orders ORDER BY o_orderkey, o_custkey LIMIT 5""")(
    lambda spark, sf: C.table_info(V.table(spark, sf, "orders"), "orders",
                                   ["o_orderkey", "o_custkey"]))

# Column lists of the test tables, as the catalog should report them.
_COLUMNS = {
    "region": "r_regionkey,r_name", "nation": "n_nationkey,n_name,n_regionkey",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,"
                "l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate",
    "events": "event_id,ts,user_id,event_type,value,props",
    "documents": "doc_id,text,lang,source,n_chars", "embeddings": "vec_id,embedding,label",
    "pages": "page_id,url,html", "benchmark": "item_id,text", "labels": "doc_id,quality,toxic",
    "conversations": "conv_id,turn,role,text"}
query("catalog_summary", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, "
    f"CAST({cols.count(',') + 1} AS BIGINT) AS column_count, '{cols}' AS columns FROM {t}"
    for t, cols in _COLUMNS.items()))(
    lambda spark, sf: C.catalog_summary({t: V.table(spark, sf, t) for t in V.TABLES}))
query("storage_usage", with_(O.UPLOADS, body="""
SELECT chat_id, COUNT(*) AS file_count, CAST(SUM(size_bytes) AS BIGINT) AS total_bytes FROM uploads GROUP BY chat_id"""))(
    lambda spark, sf: C.manifest_usage(L.uploads(spark, sf)))


@query("register_folder", " UNION ALL ".join(
    f"SELECT '{t}' AS view_name, COUNT(*) AS row_count FROM {t}" for t in V.TABLES))
def register_folder(spark, sf):
    """All tables of a folder registered as views and counted through them."""
    views = readers.register_folder(spark, sf)
    return C.catalog_summary({v: spark.table(v) for v in views}).select(
        F.col("table_name").alias("view_name"), "row_count")


@query("copy_parquet", "SELECT * FROM supplier")
def copy_parquet(spark, sf):
    """A Parquet upload taken over, read back."""
    taken = readers.copy_parquet(spark, f"{sf}/supplier.parquet", scratch_path(spark, "copy"))
    return spark.read.parquet(taken["parquet_path"])


@query("metric_names", """
SELECT c_mktsegment AS segment, COUNT(*) AS n, SUM(CAST(c_acctbal AS DECIMAL(12,2)))::DOUBLE AS visit_charge
FROM customer GROUP BY c_mktsegment""")
def metric_names(spark, sf):
    """Columns found under the names that metrics use, however they are spelled."""
    raw = V.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias(" Segment "), F.col("c_acctbal").alias("Visit Charge"))
    df = names.rename(raw, names.metric_name)
    return df.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum(
        F.col("visit_charge").cast("decimal(12,2)")).cast("double").alias("visit_charge"))


@query("without_fence", """
SELECT conv_id, turn, trim(regexp_replace(concat('```sql ', COALESCE(text, ''), ' ```'), '```(sql)?\\s*', '', 'g')) AS sql_text
FROM conversations""")
def without_fence(spark, sf):
    """Statements without the code fence around them."""
    replies = F.concat(F.lit("```sql "), F.coalesce("text", F.lit("")), F.lit(" ```"))
    return V.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.without_fence(replies).alias("sql_text"))


@query("daily_outcomes", with_(O.PROVENANCE, body="""
SELECT CAST(timestamp AS DATE) AS day, success, COUNT(*) AS query_count FROM provenance GROUP BY ALL"""))
def daily_outcomes(spark, sf):
    """Queries per day and outcome of the log."""
    return daily.daily_outcomes(L.provenance(spark, sf)).drop("total_seconds")


@query("daily_outcomes_stream", with_(O.PROVENANCE, body="""
SELECT CAST(timestamp AS DATE) AS day, success, COUNT(*) AS query_count FROM provenance GROUP BY ALL"""))
def daily_outcomes_stream(spark, sf):
    """The same counts kept by a stream over the written log, in several batches with compactions.

    The log's files are written at once, so they come in any order: days stay open for the whole log.
    """
    log, out = scratch_path(spark, "log"), scratch_path(spark, "outcomes")
    writers.append_provenance(L.provenance(spark, sf).repartition(6), log)
    daily.maintain_daily_outcomes(spark, log, out, scratch_path(spark, "stream"), compact_every=2,
                                  files_per_batch=2, lateness="20000 days").awaitTermination()
    return daily.current_daily_outcomes(spark, out).drop("total_seconds")


def _profile_sql() -> str:
    """Hints, nulls and distinct values of every column of every table."""
    return " UNION ALL ".join(f"""
SELECT '{t}' AS table_name, '{c}' AS column_name, '{_hints(c)}' AS hints, COUNT(*) - COUNT({c}) AS null_count,
  COUNT(DISTINCT {c}) AS unique_count FROM {t}""" for t, cols in _COLUMNS.items() for c in cols.split(","))


def _hints(name: str) -> str:
    found = [tag for tag, words in P.SEMANTIC_TAGS.items() if any(w in name for w in words)]
    return ",".join(found) or "unknown"


@query("profile_sink", _profile_sql())
def profile_sink(spark, sf):
    """The combined catalog of all tables, written as JSON per table and read back."""
    out = scratch_path(spark, "profiles")
    profiles = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                      [P.full_profile(V.table(spark, sf, t), t) for t in V.TABLES])
    writers.write_profile(profiles, out)
    return spark.read.schema(profiles.schema).json(out).select(
        "table_name", "column_name", F.array_join("semantic_hints", ",").alias("hints"),
        "null_count", "unique_count")


query("profile_catalog", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({len(cols.split(','))} AS BIGINT) AS column_count, "
    f"'{','.join(sorted(cols.split(',')))}' AS columns, COUNT(*) AS row_count FROM {t}"
    for t, cols in _COLUMNS.items()))(
    lambda spark, sf: _catalog_of(spark, sf, V.TABLES))


@query("stored_catalog", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, "
    f"TRUE AS distinct_close, CAST(0 AS BIGINT) AS profiled_again FROM {t}"
    for t, cols in _COLUMNS.items() for c in cols.split(",")))
def stored_catalog(spark, sf):
    """The catalog from stored states of each file; a second look finds nothing new to profile."""
    tables = {t: f"{sf.rstrip('/')}/{t}.parquet" for t in V.TABLES}
    store = scratch_path(spark, "catalog")
    PS.refresh(spark, tables, store)
    again = PS.refresh(spark, tables, store)
    exact = reduce(DataFrame.unionByName, [
        P.profile_nulls(V.table(spark, sf, t)).select(F.lit(t).alias("table_name"), "column_name", "unique_count")
        for t in V.TABLES])
    rough = PS.stored_profile(spark, tables, store).withColumnRenamed("unique_count", "rough")
    gap, n = F.abs(F.col("rough") - F.col("unique_count")), F.col("unique_count")
    return rough.join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", "row_count", "null_count",
        (gap <= n * PS.DISTINCT_ERROR + 1).alias("distinct_close"), F.lit(again).cast("bigint").alias("profiled_again"))


def _types(table: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ", 1)) for c in V.SCHEMAS[table].split(",")]


@query("table_schema", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({i + 1} AS INT) AS position, '{c}' AS column_name, '{kind}' AS type, "
    f"TRUE AS nullable, (SELECT COUNT({c}) FROM {t}) AS present"
    for t in V.TABLES for i, (c, kind) in enumerate(_types(t))))
def table_schema(spark, sf):
    """Columns of every table as its files have them, with how many values each holds."""
    parts = []
    for t in V.TABLES:
        df = spark.read.parquet(f"{sf.rstrip('/')}/{t}.parquet")
        present = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "present")
        parts.append(C.table_schema(df, t).join(present, "column_name").select(
            "table_name", "position", "column_name", "type", "nullable", "present"))
    return reduce(DataFrame.unionByName, parts)


def _catalog_of(spark, sf, tables):
    """Columns of the profiled tables, with their rows."""
    frames = {t: V.table(spark, sf, t) for t in tables}
    profiles = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                      [P.full_profile(df, t) for t, df in frames.items()])
    rows = C.catalog_summary(frames).select("table_name", "row_count")
    return writers.profile_catalog(profiles).join(rows, "table_name").select(
        "table_name", "column_count", F.array_join("columns", ",").alias("columns"), "row_count")


query("upload_manifest", with_(O.UPLOADS, body="""
SELECT *, CAST(SUM(size_bytes) OVER (PARTITION BY chat_id ORDER BY uploaded_at, file_id) AS BIGINT)
  AS total_storage_bytes FROM uploads"""))(
    lambda spark, sf: running_totals(
        L.uploads(spark, sf), ["uploaded_at", "file_id"], F.date_trunc("day", "uploaded_at"),
        Running(["chat_id"], {"total_storage_bytes": F.col("size_bytes")})))


@query("provenance_recent", with_(O.PROVENANCE, body="""
SELECT timestamp, chat_id, user_id, question, sql_query, success, row_count,
  execution_time_seconds, error
FROM provenance ORDER BY timestamp DESC, question DESC LIMIT 100"""))
def provenance_recent(spark, sf):
    """The log appended as JSON, read back, newest first."""
    out = scratch_path(spark, "provenance")
    writers.append_provenance(L.provenance(spark, sf), out)
    return writers.recent_queries(writers.read_provenance(spark, out), 100, ("question",)).drop(
        "metadata")


query("row_cap", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey, o_totalprice LIMIT 1000")(
    lambda spark, sf: G.row_cap(V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
                                .orderBy("o_orderkey", "o_totalprice"), 1000))

# --- cleaning and types ----------------------------------------------------------------------


@query("drop_empty_rows", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0")
def drop_empty_rows(spark, sf):
    blank = F.col("c_acctbal") < 0  # accounts in debit stand in for empty rows
    df = V.table(spark, sf, "customer").select(*[
        F.when(~blank, F.col(c)).alias(c) for c in ("c_custkey", "c_name", "c_acctbal")])
    return readers.clean_sheet(df)


def _narrow_sql(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, MIN({c}) AS min_value, MAX({c}) AS max_value,
  CASE WHEN MIN({c}) >= -128 AND MAX({c}) <= 127 THEN 'byte'
    WHEN MIN({c}) >= -32768 AND MAX({c}) <= 32767 THEN 'short'
    WHEN MIN({c}) >= -2147483648 AND MAX({c}) <= 2147483647 THEN 'int' ELSE 'long' END AS narrow_type
FROM {table}""" for c in columns)


query("narrow_types", _narrow_sql("lineitem", ("l_orderkey", "l_partkey", "l_suppkey")))(
    lambda spark, sf: P.narrow_types(V.table(spark, sf, "lineitem")))


@query("narrow_cast", "SELECT CAST(SUM(l_orderkey) AS BIGINT) AS orderkey_sum, "
                      "CAST(SUM(l_suppkey) AS BIGINT) AS suppkey_sum, COUNT(*) AS row_count FROM lineitem")
def narrow_cast(spark, sf):
    return P.narrow(V.table(spark, sf, "lineitem")).agg(
        F.sum("l_orderkey").alias("orderkey_sum"), F.sum("l_suppkey").alias("suppkey_sum"),
        F.count(F.lit(1)).alias("row_count"))


_LOW = " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS unique_count, COUNT(*) AS total_rows,
  COUNT(*) > 0 AND COUNT(DISTINCT {c}) / CAST(COUNT(*) AS DOUBLE) < 0.5
    AND COUNT(DISTINCT {c}) < 1000 AS is_low_cardinality FROM part""" for c in ("p_name", "p_brand", "p_type"))
query("low_cardinality", _LOW)(lambda spark, sf: P.low_cardinality(V.table(spark, sf, "part")))


@query("coerce_columns", """
SELECT COUNT(TRY_CAST(t AS DOUBLE)) AS numbers, CAST(SUM(COALESCE(TRY_CAST(t AS DECIMAL(12,2)), 0)) AS DOUBLE) AS total,
  COUNT(TRY_CAST(d AS TIMESTAMP)) AS dates
FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS t,
    CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)""")
def coerce_columns(spark, sf):
    """Text read as numbers and times; what cannot be read becomes null."""
    key = F.col("o_orderkey")
    e = Encounters(V.table(spark, sf, "orders").select(
        F.when(key % 5 == 0, "n/a").otherwise(V.money("o_totalprice").cast("string")).alias("t"),
        F.when(key % 7 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d")))
    exact = F.coalesce(F.col("t").try_cast("decimal(12,2)"), F.lit(0))
    return e.df.agg(F.count(e.number("t")).alias("numbers"), X.to_double(F.sum(exact)).alias("total"),
                    F.count(e.time("d")).alias("dates"))


# --- profiles ------------------------------------------------------------------------------


def _nulls_sql(table: str, columns) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count,
  CAST(COUNT(*) - COUNT({c}) AS DOUBLE) * 100.0 / COUNT(*) AS null_percentage,
  COUNT(DISTINCT {c}) AS unique_count FROM {table}""" for c in columns)


_ENC_COLUMNS = tuple(c.rsplit(" AS ", 1)[-1].strip() for c in V.ENCOUNTER_COLUMNS)
query("profile_nulls", with_(O.ENCOUNTERS, body=_nulls_sql("enc", _ENC_COLUMNS)))(
    lambda spark, sf: P.profile_nulls(V.encounters(spark, sf)))


@query("merged_profile", with_(O.ENCOUNTERS, body=" UNION ALL ".join(f"""
SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, CAST(MIN({c}) AS DOUBLE) AS min,
  CAST(MAX({c}) AS DOUBLE) AS max, TRUE AS distinct_close, TRUE AS median_close FROM enc"""
                                                 for c in ("charge", "balance", "unit", "total_payment"))))
def merged_profile(spark, sf):
    """States of thirteen parts of the encounters, merged; sketches are held against exact figures."""
    df = V.encounters(spark, sf).select("visit_id", "charge", "balance", "unit", "total_payment")
    df = stage_table(df, "profiled", small_tasks=True)
    names = [c for c in df.columns if c != "visit_id"]
    parts = PS.states(df, "enc", (F.col("visit_id") % 13).cast("string"))
    rough = PS.profile(PS.merge(parts)).filter("column_name <> 'visit_id'")
    exact = P.profile_nulls(df.select(*names)).select("column_name", F.col("unique_count").alias("exact_count"))
    ranks = df.unpivot([], [F.col(c).cast("double").alias(c) for c in names], "column_name", "x").join(
        F.broadcast(rough.select("column_name", "median")), "column_name").groupBy("column_name").agg(
        (F.count_if(F.col("x") < F.col("median")) / F.count("x")).alias("below"),
        (F.count_if(F.col("x") <= F.col("median")) / F.count("x")).alias("up_to"))
    error = F.lit(PS.RANK_ERROR)
    found = rough.join(exact, "column_name").join(ranks, "column_name").select(
        "column_name", "null_count", "min", "max",
        (F.abs(F.col("unique_count") - F.col("exact_count")) <= F.col("exact_count") * PS.DISTINCT_ERROR + 1)
        .alias("distinct_close"),
        ((F.col("below") <= 0.5 + error) & (F.col("up_to") >= 0.5 - error)).alias("median_close"))
    return stage_table(found, "merged_profile", small_tasks=True)


def _numeric_sql(table: str, columns) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max,
  ROUND(AVG({c}), 4) AS mean, CAST(MEDIAN({c}) AS DOUBLE) AS median, ROUND(STDDEV_SAMP({c}), 4) AS std
FROM {table}""" for c in columns)


_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("profile_numeric", _numeric_sql("lineitem", _NUMERIC))
def profile_numeric(spark, sf):
    # Means and deviations of doubles depend on the order of addition; compare four digits.
    return P.profile_numeric(V.table(spark, sf, "lineitem")).select(
        "column_name", "min", "max", F.round("mean", 4).alias("mean"), "median",
        F.round("std", 4).alias("std"))


query("profile_text", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, CAST(MIN(length({c})) AS INT) AS min_length,
  CAST(MAX(length({c})) AS INT) AS max_length, AVG(length({c})) AS avg_length FROM documents"""
                                         for c in ("text", "lang", "source")))(
    lambda spark, sf: P.profile_text(V.table(spark, sf, "documents")))
query("profile_datetime", """
SELECT 'ts' AS column_name, MIN(ts) AS min, MAX(ts) AS max,
  CAST(floor(date_diff('microsecond', MIN(ts), MAX(ts)) / 86400000000) AS BIGINT) AS range_days FROM events""")(
    lambda spark, sf: P.profile_datetime(V.table(spark, sf, "events")))
query("profile_boolean", """
SELECT 'is_low' AS column_name, COUNT(CASE WHEN quality = 0 THEN 1 END) AS true_count,
  COUNT(CASE WHEN quality <> 0 THEN 1 END) AS false_count FROM labels
UNION ALL SELECT 'is_toxic', COUNT(CASE WHEN toxic = 1 THEN 1 END),
  COUNT(CASE WHEN toxic <> 1 THEN 1 END) FROM labels""")(
    lambda spark, sf: P.profile_boolean(V.table(spark, sf, "labels").select(
        (F.col("quality") == 0).alias("is_low"), (F.col("toxic") == 1).alias("is_toxic"))))
query("profile_table", with_(O.ENCOUNTERS, body=f"""
SELECT COUNT(*) AS total_rows, CAST({len(_ENC_COLUMNS)} AS BIGINT) AS total_columns,
  {' + '.join(f'COUNT(*) - COUNT({c})' for c in _ENC_COLUMNS)} AS null_cells,
  CAST({' + '.join(f'COUNT(*) - COUNT({c})' for c in _ENC_COLUMNS)} AS DOUBLE) * 100.0
    / (COUNT(*) * {len(_ENC_COLUMNS)}) AS null_percentage FROM enc"""))(
    lambda spark, sf: P.profile_table(V.encounters(spark, sf)))

_SAMPLED = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
query("sample_values", "SELECT column_name, CAST(position AS INT) AS position, value FROM (" + """
SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) AS position
FROM (SELECT DISTINCT column_name, value FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM customer" for c in _SAMPLED) + """)
  WHERE value IS NOT NULL)) WHERE position <= 5""")(
    lambda spark, sf: P.sample_values(V.table(spark, sf, "customer")))

_TEXT_COLUMNS = ("o_orderstatus", "o_orderpriority")
query("column_patterns", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, """ + ", ".join(
    f"COUNT(CASE WHEN regexp_matches({c}, '{regex}') THEN 1 END) AS {name}"
    for name, regex in P.PATTERNS.items()) + f", AVG(length({c})) AS avg_length FROM {t}"
    for t, c in (("docs", "text"), ("docs", "source"), ("docs", "lang"))).replace("FROM docs", "FROM documents"))(
    lambda spark, sf: P.column_patterns(V.table(spark, sf, "documents").select("text", "source", "lang")))


def _pieces_sql(table: str, columns) -> str:
    rows = []
    for c in columns:
        rows += [f"SELECT '{c}' AS column_name, 'value' AS kind, {c} AS piece FROM {table} WHERE {c} IS NOT NULL",
                 f"SELECT '{c}', 'prefix', left({c}, 3) FROM {table} WHERE length({c}) >= 3",
                 f"SELECT '{c}', 'suffix', right({c}, 3) FROM {table} WHERE length({c}) >= 3"]
    return ("SELECT column_name, kind, piece, n, CAST(position AS INT) AS position FROM ("
            "SELECT *, row_number() OVER (PARTITION BY column_name, kind ORDER BY n DESC, piece) AS position "
            "FROM (SELECT column_name, kind, piece, COUNT(*) AS n FROM (" + " UNION ALL ".join(rows)
            + ") GROUP BY column_name, kind, piece)) WHERE position <= 5")


query("top_prefixes", _pieces_sql("part", ("p_name", "p_brand", "p_type")))(
    lambda spark, sf: P.top_pieces(V.table(spark, sf, "part")))


_HINTED = {t: cols.split(",") for t, cols in _COLUMNS.items()}


@query("semantic_hints", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{_hints(c)}' AS hints, COUNT({c}) AS present "
    f"FROM {t}" for t, cols in _HINTED.items() for c in cols))
def semantic_hints(spark, sf):
    """Tags of every column, with how many values it holds."""
    out = None
    for t in _HINTED:
        df = V.table(spark, sf, t)
        present = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot(
            [], df.columns, "column_name", "present")
        part = present.select(F.lit(t).alias("table_name"), "column_name", F.array_join(
            P.semantic_hints(F.col("column_name")), ",").alias("hints"), "present")
        out = part if out is None else out.unionByName(part)
    return out


# --- guarded SQL, logs and uploads ----------------------------------------------------------


@query("guarded_select", """
SELECT o_orderpriority AS priority, COUNT(*) AS n, COUNT(DISTINCT c_nationkey) AS nations
FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) >= 1998
GROUP BY o_orderpriority""")
def guarded_select(spark, sf):
    for t in ("orders", "customer"):
        V.table(spark, sf, t).createOrReplaceTempView(t)
    return G.guarded_sql(spark, """
        SELECT `o_orderpriority` AS priority, COUNT(*) AS n, COUNT(DISTINCT c_nationkey) AS nations
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE YEAR(o_orderdate) >= 1998
        GROUP BY priority LIMIT 2""")


@query("sql_functions", """
SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
  CAST(quarter(o_orderdate) AS INT) AS q, MIN(strftime(o_orderdate, '%Y-%m-%d')) AS first_day,
  MAX(last_day(o_orderdate)) AS month_end, MAX(CAST(o_orderdate AS DATE) - 7) AS week_before,
  COUNT(*) AS n, MIN(concat(o_orderstatus, '-', COALESCE(NULL, 'x'))) AS tag,
  COUNT(CASE WHEN o_orderdate IS NULL THEN 1 END) AS undated
FROM orders GROUP BY year(o_orderdate), month(o_orderdate), quarter(o_orderdate) HAVING COUNT(*) > 1""")
def sql_functions(spark, sf):
    """The functions ad-hoc queries may use, in Spark's spelling."""
    V.table(spark, sf, "orders").createOrReplaceTempView("orders")
    return G.guarded_sql(spark, """
        SELECT EXTRACT(YEAR FROM o_orderdate) AS y, MONTH(o_orderdate) AS m, QUARTER(o_orderdate) AS q,
          MIN(DATE_FORMAT(o_orderdate, 'yyyy-MM-dd')) AS first_day, MAX(LAST_DAY(o_orderdate)) AS month_end,
          MAX(DATE_SUB(o_orderdate, 7)) AS week_before, COUNT(*) AS n,
          MIN(CONCAT(o_orderstatus, '-', IFNULL(NULL, 'x'))) AS tag,
          COUNT_IF(ISNULL(o_orderdate)) AS undated
        FROM orders GROUP BY y, m, q HAVING n > 1""")


query("row_json", """
SELECT concat('{"c_custkey":', CAST(c_custkey AS VARCHAR), ',"c_name":"', c_name, '","half":',
  CASE WHEN c_custkey % 2 = 0 THEN 'null' ELSE '0.5' END,
  ',"since":"', strftime(TIMESTAMP '2001-01-01' + to_days(CAST(c_custkey % 365 AS INT)), '%Y-%m-%dT%H:%M:%S'), '"}') AS json
FROM customer""")(lambda spark, sf: G.json_rows(V.table(spark, sf, "customer").select(
    "c_custkey", "c_name",
    F.when(F.col("c_custkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(0.5)).alias("half"),
    X.shift_days(F.lit("2001-01-01").cast("timestamp_ntz"), F.col("c_custkey") % 365).alias("since"))))
query("pii_guard", "SELECT c_custkey, c_name FROM customer")(
    lambda spark, sf: G.guard_columns(V.table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.col("c_acctbal").alias("Credit_Card"),
        F.col("c_mktsegment").alias("password")), mode="drop"))



@query("nested_pii", """
SELECT c_custkey, concat('{"name":"', c_name, '","logins":[{"phone":"', CAST(c_nationkey AS VARCHAR), '"}]}') AS person,
  c_nationkey AS nation FROM customer WHERE c_nationkey IS NOT NULL""")
def nested_pii(spark, sf):
    """Personal fields inside structs, arrays and maps are not there for a query."""
    people = V.table(spark, sf, "customer").selectExpr(
        "c_custkey", "named_struct('name', c_name, 'SSN', c_acctbal, 'logins', array(named_struct('password', "
        "c_mktsegment, 'phone', CAST(c_nationkey AS STRING)))) AS person",
        "map('ssn', c_acctbal, 'nation', c_nationkey) AS facts")
    return G.guarded_sql(spark, """
        SELECT c_custkey, TO_JSON(person) AS person, CAST(facts['nation'] AS INT) AS nation FROM people
        WHERE facts['nation'] IS NOT NULL AND facts['ssn'] IS NULL""", tables={"people": people})


@query("sql_aggregates", """
SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INT) AS y, CAST(day(max(o_orderdate)) AS INT) AS last_day,
  CAST(max(o_orderdate) AS DATE) AS last_date, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total,
  CAST(AVG(o_custkey) AS DOUBLE) AS mean_customer, o_orderstatus AS any_status, TRUE AS past
FROM orders GROUP BY o_orderstatus, year(o_orderdate)""")
def sql_aggregates(spark, sf):
    """The other functions of ad-hoc queries."""
    return G.guarded_sql(spark, """
        SELECT o_orderstatus AS status, YEAR(o_orderdate) AS y, DAY(MAX(o_orderdate)) AS last_day,
          DATE(MAX(o_orderdate)) AS last_date, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total,
          AVG(o_custkey) AS mean_customer, ANY_VALUE(o_orderstatus) AS any_status,
          MAX(o_orderdate) < CURDATE() AS past
        FROM orders GROUP BY o_orderstatus, YEAR(o_orderdate)""",
                         tables={"orders": V.table(spark, sf, "orders")})


@query("guard_findings", """
SELECT * FROM (VALUES ('alias', 'refused'), ('comment', 'refused'), ('comma', 'refused'), ('constant', 'refused'),
  ('equal', 'runs'), ('literal', 'runs')) AS v(attempt, outcome), (SELECT COUNT(*) AS customers FROM customer) AS c""")
def guard_findings(spark, sf):
    """What the guard says of statements that try to get past it."""
    V.table(spark, sf, "customer").withColumnRenamed("c_name", "ssn").createOrReplaceTempView("people")
    attempts = {"alias": "SELECT c_custkey, ssn AS x FROM people", "comment": 'SELECT "--", ssn AS x FROM people',
                "comma": "SELECT a.c_custkey FROM people a, people b",
                "constant": "SELECT a.c_custkey FROM people a JOIN people b ON 1 = 1",
                "equal": "SELECT a.c_custkey FROM people a, people b WHERE a.c_custkey = b.c_custkey",
                "literal": "SELECT 'ssn' AS w, \"drop\" AS d FROM people"}

    def outcome(sql):
        try:
            G.guarded_sql(spark, sql)
            return "runs"
        except G.QueryRefused:
            return "refused"

    found = F.explode(F.create_map(*[F.lit(x) for a, s in attempts.items() for x in (a, outcome(s))]))
    return V.table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("customers")).select(
        found.alias("attempt", "outcome"), "customers")


_JOINS_SQL = " + ".join(f"len(regexp_extract_all(u, '{p}'))" for p in Q.JOIN_PATTERNS)


def _first_hit_sql(column: str, words) -> str:
    whens = " ".join(f"WHEN regexp_matches({column}, '\\b{w}\\b') THEN '{w}'" for w in words)
    return f"CASE {whens} END"


_OPERATION_SQL = "upper(regexp_extract(s, '^([A-Za-z_]+|\\S)', 1))"
query("sql_audit", with_(O.PROVENANCE, f"""
st AS (SELECT event_id, sql_query, regexp_replace(sql_query, '^\\s+|\\s+$', '', 'g') AS s FROM provenance),
up AS (SELECT *, upper(s) AS u, {_OPERATION_SQL} AS operation FROM st),
fnd AS (SELECT *, {_first_hit_sql('u', Q.FORBIDDEN_WORDS)} AS forbidden_word,
    CAST({_JOINS_SQL} AS BIGINT) AS join_count, regexp_matches(u, '\\bCROSS\\s+JOIN\\b') AS has_cross_join,
    {_first_hit_sql('lower(s)', Q.PII_COLUMNS)} AS pii_column,
    TRY_CAST(NULLIF(regexp_extract(u, 'LIMIT\\s+(\\d+)', 1), '') AS BIGINT) AS limit_value FROM up),
ver AS (SELECT *, CASE WHEN s = '' THEN 'Empty SQL query'
    WHEN operation <> 'SELECT' THEN concat('Operation ''', operation, ''' not allowed. Only SELECT operations are permitted.')
    WHEN forbidden_word IS NOT NULL THEN concat('Forbidden keyword ''', forbidden_word, ''' detected')
    WHEN has_cross_join THEN 'CROSS JOIN is not allowed (potential cartesian product)'
    WHEN join_count > 3 THEN concat('Too many JOINs (', CAST(join_count AS VARCHAR), '). Maximum allowed: 3')
    WHEN pii_column IS NOT NULL THEN concat('Query references PII column ''', pii_column, ''' which is not allowed') END AS error
  FROM fnd)""", body="""
SELECT event_id, sql_query, operation, forbidden_word, join_count, has_cross_join, pii_column, limit_value,
  error IS NULL AS valid, error,
  CASE WHEN error IS NULL THEN CASE WHEN NOT contains(u, 'LIMIT')
      THEN concat(regexp_replace(regexp_replace(s, ';+$', ''), '\\s+$', ''), ' LIMIT 1000')
    WHEN limit_value > 1000 THEN regexp_replace(s, '(?i)LIMIT\\s+\\d+', 'LIMIT 1000', 'g') ELSE s END END AS sanitized_sql
FROM ver"""))(lambda spark, sf: G.audit_sql_log(L.statements(spark, sf), "sql_query").drop("tables"))

_USED = with_(O.PROVENANCE, f"""
used AS (SELECT event_id, {L.STAR_TABLE_SQL} AS table_name FROM events
    WHERE event_id % {len(L.STATEMENTS)} NOT IN (3, 10)
  UNION ALL SELECT event_id, 'payment' FROM events WHERE event_id % {len(L.STATEMENTS)} = 8
    AND {L.STAR_TABLE_SQL} <> 'payment')""", body="{}")
query("sql_tables", _USED.format("SELECT DISTINCT table_name FROM used"))(
    lambda spark, sf: G.sql_tables(L.statements(spark, sf), "sql_query"))
query("table_usage", _USED.format(
    "SELECT table_name, COUNT(*) AS usage_count FROM used GROUP BY table_name"))(
    lambda spark, sf: G.table_usage(L.statements(spark, sf), "sql_query"))

_RETRY = " ".join(f"WHEN contains(upper(error), '{w}') THEN '{w}'" for w in Q.DATABASE_RETRY_WORDS)
query("error_triage", with_(O.PROVENANCE, body=f"""
SELECT c AS error_class, COUNT(*) AS query_count, c <> 'none' AS retryable
FROM (SELECT CASE {_RETRY} ELSE 'none' END AS c FROM provenance WHERE error IS NOT NULL AND error <> '')
GROUP BY c"""))(lambda spark, sf: G.error_triage(L.provenance(spark, sf), "error"))

_EXT_SQL = "lower(regexp_extract(b, '^.+(\\.[^.]+)$', 1))"
_STEM_SQL = "left(b, length(b) - length(regexp_extract(b, '^.+(\\.[^.]+)$', 1)))"
_SAFE_SQL = ("left(trim(regexp_replace(regexp_replace(" + _STEM_SQL
             + ", '[^\\w\\s\\-.]', '_', 'g'), '[\\s_]+', '_', 'g'), '_.'), 100)")
_NAMES_SQL = f"""
base AS (SELECT *, regexp_extract(original_name, '([^/]*)/*$', 1) AS b FROM uploads),
named AS (SELECT *, {_EXT_SQL} AS extension,
    concat(CASE WHEN {_SAFE_SQL} = '' THEN 'upload' ELSE {_SAFE_SQL} END, {_EXT_SQL}) AS sanitized_name FROM base)"""
query("sanitize_filename", with_(O.UPLOADS, _NAMES_SQL, body=(
    "SELECT file_id, original_name, sanitized_name, extension FROM named")))(
    lambda spark, sf: L.uploads(spark, sf).select(
        "file_id", "original_name", text.sanitize_filename(F.col("original_name")).alias("sanitized_name"),
        text.extension(F.col("original_name")).alias("extension")))
_SUPPORTED = ", ".join(f"'{e}'" for e in text.SUPPORTED_EXTENSIONS)
_DANGEROUS = ", ".join(f"'{e}'" for e in text.DANGEROUS_EXTENSIONS)
_MB = "format('{{:.2f}}MB', CAST({} AS DOUBLE) / 1048576)"
query("upload_validation", with_(O.UPLOADS, _NAMES_SQL, f"""
ok AS (SELECT *, size_bytes > 0 AND size_bytes <= {G.MAX_FILE_BYTES} AND extension IN ({_SUPPORTED}) AS sound FROM named),
prior AS (SELECT *,
    CAST(COUNT(CASE WHEN sound THEN 1 END) OVER (PARTITION BY chat_id ORDER BY uploaded_at, file_id)
      - CASE WHEN sound THEN 1 ELSE 0 END AS BIGINT) AS prior_files,
    CAST(COALESCE(SUM(CASE WHEN sound THEN size_bytes END) OVER (PARTITION BY user_id ORDER BY uploaded_at, file_id), 0)
      - CASE WHEN sound THEN size_bytes ELSE 0 END AS BIGINT) AS prior_bytes FROM ok),
judged AS (SELECT *,
  CASE WHEN size_bytes = 0 THEN 'empty' WHEN size_bytes > {G.MAX_FILE_BYTES} THEN 'too_large'
    WHEN prior_files >= 5 THEN 'too_many_files'
    WHEN prior_bytes + size_bytes > {G.MAX_USER_BYTES} THEN 'quota_exceeded'
    WHEN extension NOT IN ({_SUPPORTED}) THEN 'unsupported_format'
    WHEN extension IN ({_DANGEROUS}) THEN 'dangerous_type' ELSE 'accepted' END AS verdict
  FROM prior)""", body=f"""
SELECT file_id, chat_id, user_id, sanitized_name, extension, prior_files, prior_bytes, verdict,
  CASE verdict WHEN 'empty' THEN 'File is empty'
    WHEN 'too_large' THEN concat('File too large: ', {_MB.format('size_bytes')}, '. Maximum allowed: 200.00MB')
    WHEN 'too_many_files' THEN 'Maximum files per chat (5) exceeded'
    WHEN 'quota_exceeded' THEN concat('User storage quota exceeded. Current: ', {_MB.format('prior_bytes')},
      ', File: ', {_MB.format('size_bytes')}, ', Limit: 500.00MB')
    WHEN 'dangerous_type' THEN concat('File type not allowed for security reasons: ', extension)
    WHEN 'unsupported_format' THEN concat('Unsupported file format: ', extension,
      '. Supported formats: {', '.join(text.SUPPORTED_EXTENSIONS)}') END AS message
FROM judged"""))(lambda spark, sf: G.validate_uploads(
    L.uploads(spark, sf), F.date_trunc("day", "uploaded_at")).select(
        "file_id", "chat_id", "user_id", "sanitized_name", "extension", "prior_files",
        "prior_bytes", "verdict", "message"))
query("validate_sheet_name", with_(O.SHEETS, body=f"""
SELECT page_id, sheet_name, CASE WHEN trim(regexp_replace(sheet_name, '\\s', ' ', 'g')) = '' THEN 'Sheet has empty name'
  WHEN upper(sheet_name) IN ({', '.join(f"'{w}'" for w in text.SQL_WORDS)}) THEN concat('Sheet name ''', sheet_name, ''' is a SQL keyword')
  WHEN NOT regexp_matches(sheet_name, '^[a-zA-Z0-9_\\s\\-]+$') THEN concat('Sheet name ''', sheet_name, ''' contains invalid characters') END AS error
FROM sheets"""))(lambda spark, sf: L.sheet_names(spark, sf).select(
    "page_id", "sheet_name", text.sheet_name_error(F.col("sheet_name")).alias("error")))
query("quota_usage", with_(O.UPLOADS, body=f"""
SELECT 'chat' AS scope, CAST(chat_id AS VARCHAR) AS owner, COUNT(*) AS used, CAST(5 AS BIGINT) AS quota,
  CAST(greatest(0, 5 - COUNT(*)) AS BIGINT) AS remaining, COUNT(*) / 5.0::DOUBLE * 100.0 AS used_pct FROM uploads GROUP BY chat_id
UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), CAST(SUM(size_bytes) AS BIGINT), CAST({G.MAX_USER_BYTES} AS BIGINT),
  CAST(greatest(0, {G.MAX_USER_BYTES} - SUM(size_bytes)) AS BIGINT),
  CAST(SUM(size_bytes) AS DOUBLE) / {G.MAX_USER_BYTES}.0::DOUBLE * 100.0 FROM uploads GROUP BY user_id"""))(
    lambda spark, sf: G.quota_usage(L.uploads(spark, sf)))

# --- conversations ---------------------------------------------------------------------------

for _n, _name in ((H.HISTORY_MESSAGES, "chat_history"), (3, "chat_history_short")):
    query(_name, f"""
SELECT conv_id, string_agg(concat(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END,
    COALESCE(text, '')), chr(10) ORDER BY turn) AS history, COUNT(*) AS message_count
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations
  WHERE role IN ('user', 'assistant')) WHERE r <= {_n} GROUP BY conv_id""")(
        lambda spark, sf, n=_n: H.chat_history(V.table(spark, sf, "conversations"), n))


def _title_sql(expr: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({expr}, '\\p{{L}}+|\\P{{L}}+'), "
            "lambda x: concat(upper(x[1]), lower(x[2:]))), '')")


def _after_sql(word: str) -> str:
    return f"NULLIF({_title_sql(f'''trim(regexp_extract(q, '(?:^|\\s){word}\\s+(\\S+)', 1), ',.!?')''')}, '')"


_PHRASES = " OR ".join(f"contains(q, '{p}')" for p in text.REPORT_PHRASES)
query("intent_classify", with_(O.QUESTIONS, body=f"""
SELECT conv_id, turn, question, {_PHRASES} AS is_weekly_report,
  COALESCE({', '.join(_after_sql(w) for w in reversed(text.COMPANY_WORDS))},
    CASE WHEN contains(q, '--') THEN {_title_sql("trim(split_part(q, '--', 2))")} END, 'Company') AS company_name
FROM (SELECT *, lower(question) AS q FROM questions)"""))(
    lambda spark, sf: H.classify_intents(L.questions(spark, sf), "question"))

# --- request rates ----------------------------------------------------------------------------


def _rate_sql(unit: str, limit: int) -> str:
    return f"""
SELECT user_id, w AS window_start, w + INTERVAL 1 {unit} AS window_end, COUNT(*) AS request_count
FROM (SELECT user_id, date_trunc('{unit}', ts) AS w FROM events) GROUP BY user_id, w
HAVING COUNT(*) > {limit}"""


# Limits low enough to be broken at the events' density.
for _unit, _limit in (("minute", 1), ("hour", 2), ("day", 5)):
    query(f"rate_breach_{_unit}", _rate_sql(_unit, _limit))(
        lambda spark, sf, u=_unit, n=_limit: rates.rate_breaches(
            V.table(spark, sf, "events"), f"1 {u}", n))


@query("rate_breach_stream", f"""
SELECT * FROM ({_rate_sql('hour', 2)})
WHERE window_end <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""")
def rate_breach_stream(spark, sf):
    """The same job as a stream over the events file; open windows are held back."""
    schema = V.table(spark, sf, "events").schema
    events = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(sf))
    out = scratch_path(spark, "breaches")
    started = rates.stream_to_parquet(
        rates.rate_breaches(events, "1 hour", 2), out, scratch_path(spark, "stream"))
    started.awaitTermination()
    return spark.read.schema("user_id bigint, window_start timestamp_ntz, window_end timestamp_ntz, "
                             "request_count bigint").parquet(out)


# The declared limits, and lower ones that the events' density breaks.
_LOW_LIMITS = {f"low_per_{u}": (f"1 {u}", n) for u, n in (("minute", 1), ("hour", 2), ("day", 5))}


def _limits_sql(limits, closed: str = "TRUE") -> str:
    parts = [f"SELECT '{name}' AS limit_name, * FROM ({_rate_sql(window.split()[1], most)}) WHERE {closed}"
             for name, (window, most) in limits.items()]
    return " UNION ALL ".join(parts)


_ALL_LIMITS = {**rates.RATE_LIMITS, **_LOW_LIMITS}
query("rate_breach_all", _limits_sql(_ALL_LIMITS))(
    lambda spark, sf: rates.all_breaches(V.table(spark, sf, "events"), _ALL_LIMITS))


@query("rate_breach_all_stream", _limits_sql(
    _ALL_LIMITS, "window_end <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE"))
def rate_breach_all_stream(spark, sf):
    """All limits from one stream over the events file; open windows are held back."""
    schema = V.table(spark, sf, "events").schema
    events = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(sf))
    breaches, out = rates.all_breaches(events, _ALL_LIMITS), scratch_path(spark, "breaches")
    rates.stream_to_parquet(breaches, out, scratch_path(spark, "stream")).awaitTermination()
    return spark.read.schema(breaches.schema).parquet(out)


# --- text report -------------------------------------------------------------------------------


def _deck_rollup(spark: SparkSession, sf: str) -> Rollup:
    """Sums for all slides. The joined view is written once, since one aggregation per date reads it."""
    e = enc(spark, sf)
    return Rollup(stage_table(e.df.select(*render.deck_columns(e)), "encounters"))


query("tool_answers", report_oracle.answers_sql(ORACLE))(
    lambda spark, sf: render.tool_answers(Rollup(enc(spark, sf), only=TOOL_SLICES), AS_OF))
_COMPANY = "Acme Health"
query("report_lines", report_oracle.deck_sql(
    {**ORACLE, "client_week": _week_sql("TRUE"), "month_to_date": _mtd_sql("SELECT * FROM enc")},
    _COMPANY, AS_OF))(
    lambda spark, sf: render.report_lines(_deck_rollup(spark, sf), _COMPANY, AS_OF))
query("all_quarters_lines", report_oracle.all_quarters_sql(ORACLE["quarterly_kpis"], _COMPANY, AS_OF))(
    lambda spark, sf: render.all_quarters_lines(enc(spark, sf), _COMPANY, AS_OF))
