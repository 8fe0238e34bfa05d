"""Billing tables derived from the test tables.

The wide encounter table and the billing star schema are expressions over
``lineitem``, ``orders``, ``customer``, ``nation`` and ``part``; logs and
manifests come from ``events``, ``pages`` and ``conversations``. Money is cast
to decimals first, so sums do not depend on row order.

No join here is hinted: nation and other small sides are broadcast when their
size, as Spark measures it, is below the threshold, and shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the test tables; reading with them skips the inference job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = tuple(SCHEMAS)

# Fixed values of the derived test data.
VISIT_STATUSES = ("Approved", "On Hold", "Alert", "Pending Auth", "Reviewed",
                  "Eligibility Failed", "Missing Facesheet", "Issues Pending",
                  "Client Requested Hold", "Credentialing Hold", "Rejected", None,
                  " CLAIM CREATED ")
CLAIM_STATUSES = ("Completed", "Payment Received", "Sent To Payer", "Transmitted", "Unpaid",
                  "Denial", "Pending Payment Received", "Missing Auth", None)
CPT_CODES = ("00001", "90221", None)
STAR_STATUSES = ("Open", "Scheduled", "Checked In", "In Review", "Coded", "Claim Created",
                 "Submitted", "Approved", "Rejected", "On Hold", "Appealed", "Paid", "Cancelled",
                 "Closed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(key: str, values, otherwise: str) -> str:
    """SQL for ``values[key]``, else ``otherwise``."""
    whens = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else quote(v)}" for i, v in enumerate(values))
    return f"CASE CAST({key} AS INT) {whens} ELSE {quote(otherwise)} END"


def money(name: str) -> Column:
    return F.col(name).cast("decimal(12,2)")


ENCOUNTER_COLUMNS = (
    "l_orderkey * 10 + l_linenumber AS visit_id",
    "o_orderdate AS visit_date",
    "l_shipdate AS visit_created_date",
    "l_shipdate AS bill_date",
    "l_shipdate AS transaction_date",
    pick("l_partkey % 17", VISIT_STATUSES, "Claim Created") + " AS visit_status",
    pick("l_suppkey % 10", CLAIM_STATUSES, "Open") + " AS claim_status",
    "CASE WHEN l_partkey % 29 <> 0 THEN l_partkey % 14 END AS status_code",
    pick("l_partkey % 23", CPT_CODES, "99214") + " AS cpt_code",
    "CASE WHEN l_suppkey % 31 <> 0 THEN l_suppkey % 12 END AS transaction_type",
    "CASE WHEN l_linenumber = 7 THEN -p ELSE p END AS charge",
    "CASE WHEN l_linenumber <> 6 THEN p * (1 - d) END AS expected",
    "p * x * 10 AS total_payment",
    "p * (1 - x * 10) AS balance",
    "p * x * 6 AS primary_payment",
    "p * x * 2 AS secondary_payment",
    "p * x AS tertiary_payment",
    "p * x AS patient_payment",
    "unit",
    "CASE WHEN l_linenumber <> 5 THEN p END AS cpt_amount",
    "CASE WHEN c_nationkey <> 24 THEN n_name END AS state",
    """CASE CAST(l_suppkey % 40 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'nan'
       WHEN 3 THEN 'CO-45: contractual' WHEN 4 THEN 'PR-10: patient'
       ELSE concat('  CO-', CAST(l_suppkey % 40 + 100 AS STRING), ':   Claim   lacks  info ')
       END AS code_description""",
)


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visit line.

    Orders meet customers and nations first: that side is a quarter of the
    lines, so lines themselves are shuffled once, on the order key. Money is
    cast before the join, once per line.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    visits = (orders.join(customer, F.expr("o_custkey = c_custkey"))
              .join(nation, F.expr("c_nationkey = n_nationkey")))
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
        "CAST(l_quantity AS INT) AS unit", "CAST(l_extendedprice AS DECIMAL(12,2)) AS p",
        "CAST(l_tax AS DECIMAL(4,2)) AS x", "CAST(l_discount AS DECIMAL(4,2)) AS d")
    return lines.join(visits, F.expr("l_orderkey = o_orderkey")).selectExpr(*ENCOUNTER_COLUMNS)


def status_filtered(e: DataFrame) -> DataFrame:
    """Encounters whose only status column is the numeric one."""
    return e.drop("visit_status", "claim_status").withColumnRenamed("status_code", "status")


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five billing tables."""
    patient_visit = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_orderdate AS visit_date", "o_orderkey % 14 AS status",
        "CASE WHEN o_orderkey % 19 = 0 THEN o_orderdate END AS deleted_at")
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 "
        "+ l_partkey * 10000 + l_suppkey AS id",
        "l_orderkey AS visit_id", "l_partkey AS cpt_id", "CAST(l_quantity AS INT) AS unit",
        "CASE WHEN l_linenumber <> 5 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS cpt_amount",
        "CASE WHEN l_linenumber = 4 AND l_suppkey % 5 = 0 THEN l_shipdate END AS deleted_at")
    cpt_codes = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", pick("p_partkey % 23", CPT_CODES, "99214") + " AS cpt_code",
        "CASE WHEN p_partkey % 37 = 0 THEN TIMESTAMP_NTZ'2001-01-01' END AS deleted_at")
    payment = lines.selectExpr(
        "id AS encounter_id", "COALESCE(cpt_amount, 0) AS amount", "id % 12 AS transaction_type",
        "CASE WHEN id % 41 = 0 THEN TIMESTAMP_NTZ'2001-01-01' END AS deleted_at")
    visit_status = spark.createDataFrame(list(enumerate(STAR_STATUSES)), "id bigint, name string")
    return {"patient_visit": patient_visit, "patient_visit_cpt": lines, "cpt_codes": cpt_codes,
            "payment": payment, "visit_status": visit_status}
