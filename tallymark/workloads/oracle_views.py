"""The derived tables of ``views`` and ``logs`` as SQL, for the oracle."""

from __future__ import annotations

from tallymark.workloads import logs as L
from tallymark.workloads import views as V


_P = "CAST(l_extendedprice AS DECIMAL(12,2))"
_X = "CAST(l_tax AS DECIMAL(4,2))"
_D = "CAST(l_discount AS DECIMAL(4,2))"

ENCOUNTERS = f"""
enc AS (
  SELECT l_orderkey * 10 + l_linenumber AS visit_id, o_orderdate AS visit_date,
    l_shipdate AS visit_created_date, l_shipdate AS bill_date, l_shipdate AS transaction_date,
    {V.pick('l_partkey % 17', V.VISIT_STATUSES, 'Claim Created')} AS visit_status,
    {V.pick('l_suppkey % 10', V.CLAIM_STATUSES, 'Open')} AS claim_status,
    CASE WHEN l_partkey % 29 <> 0 THEN l_partkey % 14 END AS status_code,
    {V.pick('l_partkey % 23', V.CPT_CODES, '99214')} AS cpt_code,
    CASE WHEN l_suppkey % 31 <> 0 THEN l_suppkey % 12 END AS transaction_type,
    CASE WHEN l_linenumber = 7 THEN -{_P} ELSE {_P} END AS charge,
    CASE WHEN l_linenumber <> 6 THEN {_P} * (1 - {_D}) END AS expected,
    {_P} * {_X} * 10 AS total_payment, {_P} * (1 - {_X} * 10) AS balance,
    {_P} * {_X} * 6 AS primary_payment, {_P} * {_X} * 2 AS secondary_payment,
    {_P} * {_X} AS tertiary_payment, {_P} * {_X} AS patient_payment,
    CAST(l_quantity AS INT) AS unit, CASE WHEN l_linenumber <> 5 THEN {_P} END AS cpt_amount,
    CASE WHEN c_nationkey <> 24 THEN n_name END AS state,
    CASE CAST(l_suppkey % 40 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'nan'
      WHEN 3 THEN 'CO-45: contractual' WHEN 4 THEN 'PR-10: patient'
      ELSE concat('  CO-', CAST(l_suppkey % 40 + 100 AS VARCHAR), ':   Claim   lacks  info ')
      END AS code_description
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

STAR = f"""
patient_visit AS (
  SELECT o_orderkey AS id, o_orderdate AS visit_date, o_orderkey % 14 AS status,
    CASE WHEN o_orderkey % 19 = 0 THEN o_orderdate END AS deleted_at FROM orders),
patient_visit_cpt AS (
  SELECT l_orderkey * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000
      + l_partkey * 10000 + l_suppkey AS id,
    l_orderkey AS visit_id, l_partkey AS cpt_id, CAST(l_quantity AS INT) AS unit,
    CASE WHEN l_linenumber <> 5 THEN {_P} END AS cpt_amount,
    CASE WHEN l_linenumber = 4 AND l_suppkey % 5 = 0 THEN l_shipdate END AS deleted_at
  FROM lineitem),
cpt_codes AS (
  SELECT p_partkey AS id, {V.pick('p_partkey % 23', V.CPT_CODES, '99214')} AS cpt_code,
    CASE WHEN p_partkey % 37 = 0 THEN TIMESTAMP '2001-01-01' END AS deleted_at FROM part),
payment AS (
  SELECT id AS encounter_id, COALESCE(cpt_amount, 0) AS amount, id % 12 AS transaction_type,
    CASE WHEN id % 41 = 0 THEN TIMESTAMP '2001-01-01' END AS deleted_at FROM patient_visit_cpt),
visit_status AS (SELECT * FROM (VALUES {', '.join(
    f"({i}, {V.quote(s)})" for i, s in enumerate(V.STAR_STATUSES))}) t(id, name))"""

PROVENANCE = f"""
provenance AS (
  SELECT event_id, ts AS timestamp, concat('chat_', CAST(event_id % 20 AS VARCHAR)) AS chat_id,
    CAST(user_id AS VARCHAR) AS user_id, concat('question ', CAST(event_id AS VARCHAR)) AS question,
    {L.STATEMENT_SQL} AS sql_query, event_type <> 'error' AS success,
    event_id % 1000 AS row_count, value AS execution_time_seconds,
    CASE WHEN event_type = 'error' THEN {L.ERROR_SQL} END AS error
  FROM events)"""

QUESTIONS = f"""
questions AS (
  SELECT conv_id, turn, {L.QUESTION_SQL} AS question FROM conversations WHERE role = 'user')"""

UPLOADS = f"""
uploads AS (
  SELECT page_id AS file_id, page_id % 40 AS chat_id, page_id % 8 AS user_id,
    {L.FILE_NAME_SQL} AS original_name, CAST({L.SIZE_SQL} AS BIGINT) AS size_bytes,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS uploaded_at
  FROM pages)"""

SHEETS = f"""
sheets AS (SELECT page_id, {L.SHEET_SQL} AS sheet_name FROM pages)"""


def with_(*views: str, body: str) -> str:
    return "WITH " + ",".join(views) + "\n" + body


# --- KPI formulas -----------------------------------------------------------------


def money(expr: str, where: str = "") -> str:
    kept = f"CASE WHEN {where} THEN {expr} END" if where else expr
    return f"COALESCE(CAST(SUM({kept}) AS DOUBLE), 0.0)"


def pct(n: str, d: str) -> str:
    return f"(CASE WHEN {d} = 0 THEN 0.0 ELSE {n} / {d} END * 100.0)"


CHARGES = money("charge", "charge > 0")
PAYMENTS = money("total_payment")
EXPECTED = money("expected")
BALANCE = money("balance")
SUBMITTED = money("charge", "charge > 0 AND regexp_matches(lower(visit_status), "
                            "'claim created|submitted|billed')")
SUBMITTED_PCT = pct(SUBMITTED, CHARGES)
GCR = pct(PAYMENTS, CHARGES)
NCR = pct(PAYMENTS, EXPECTED)
ENDING_AR = f"(CASE WHEN {BALANCE} = 0 THEN {CHARGES} - {PAYMENTS} ELSE {BALANCE} END)"
BILLED_FLAG = "COALESCE(lower(trim(visit_status)) = 'claim created', FALSE)"


def ar_days(period: str) -> str:
    return (f"CAST(CASE WHEN {CHARGES} = 0 THEN 0 "
            f"ELSE ceil({ENDING_AR} / ({CHARGES} / ({period}))) END AS BIGINT)")


# Filtered sums: nulls match no exclusion.
KEEP_CPT = "COALESCE(cpt_code, '') NOT IN ('00001', '00002', '00003', '90221', '90222')"
KEEP_TRANSACTION = "COALESCE(transaction_type, -1) NOT IN (9, 10)"
KEEP_STATUS = "COALESCE(status_code, -1) <> 12"
