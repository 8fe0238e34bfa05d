"""Which column plays which role in an encounter table.

Input tables name their columns freely, so each metric looks for the first name
of an ordered list. The lists differ by metric on purpose and are not merged:
a table holding both ``total_charges`` and ``total_charge`` gives different
columns to the total and to the filtered charge sum.
"""

from __future__ import annotations

from collections.abc import Iterable

_SERVICE_DATE = ("visit_date", "date", "dos", "date_of_service", "service_date")
_BALANCE = ("balance", "ar", "ar_balance", "outstanding_balance")
_EXPECTED = ("expected", "expected_payment", "expected_amount")

# Role and context -> candidate column names, first match wins.
CANDIDATES: dict[tuple[str, str], tuple[str, ...]] = {
    ("visits", "total"): ("visits", "encounters", "visit", "encounter", "visit_count"),
    ("charge", "total"): ("charge", "charges", "total_charges", "billed_amount", "charge_amount"),
    ("charge", "submitted"): ("charge", "charges", "charge_amount", "total_charge", "billed_amount"),
    ("charge", "filtered"): ("charge", "charges", "total_charge", "billed_amount"),
    ("charge", "progress"): ("charge", "charges", "total_charges", "billed_amount"),
    ("charge", "tool_total"): ("charge", "charges", "total_charges"),
    ("charge", "tool_rate"): ("charge", "charges"),
    ("unit", "filtered"): ("unit", "units", "quantity", "qty"),
    ("amount", "filtered"): ("cpt_amount", "amount", "charge_amount", "price", "rate"),
    ("payment", "total"): (
        "total_payment", "payment", "payments", "collections", "paid_amount", "payment_amount"),
    ("payment", "filtered"): (
        "total_payment", "payment", "payments", "payment_amount", "paid_amount", "collection"),
    ("payment", "tool_rate"): ("total_payment", "payment"),
    ("expected", "total"): (*_EXPECTED, "allowed", "allowed_amount", "contracted_amount"),
    ("expected", "filtered"): (
        "allowed", "expected", "allowed_amount", "expected_payment", "expected_amount",
        "contracted_amount"),
    ("expected", "denials"): ("expected", "expected_payment", "expected_reimbursement"),
    ("expected", "tool_rate"): ("expected", "expected_payment"),
    ("contractual", "total"): (
        "contractuals", "contractual", "contractual_adjustments", "contractual_adj"),
    ("balance", "total"): _BALANCE,
    ("balance", "aged"): ("ar", "balance", "ar_balance", "outstanding_balance"),
    ("balance", "tool"): ("balance", "ar_balance"),
    ("status", "submitted"): ("visit_status", "claim_status", "status", "submission_status", "label"),
    ("status", "billed"): ("claim_status", "visit_status", "status", "label"),
    ("status", "filtered"): ("visit_status", "claim_status", "status"),
    ("status", "tool"): ("visit_status", "status"),
    ("status", "unbilled_week"): ("visit_status", "visitstatus"),
    ("cpt", "filtered"): ("cpt_code", "cpt", "procedure_code"),
    ("transaction_type", "filtered"): ("transaction_type", "payment_type", "trans_type"),
    ("service_date", "default"): _SERVICE_DATE,
    ("service_date", "period"): (*_SERVICE_DATE, "transaction_date", "claim_date"),
    ("service_date", "progress"): (*_SERVICE_DATE, "transaction_date"),
    ("service_date", "month_to_date"): ("visit_date", "visitdate"),
    ("service_date", "unbilled_week"): ("visit_date", "visitdate", "date"),
    ("service_date", "breakdown"): ("visit_date", "visitdate", "date", "dos", "date_of_service"),
    ("service_date", "aged"): ("date", "dos", "date_of_service", "service_date", "transaction_date"),
    ("service_date", "tool"): ("visit_date", "date", "dos"),
    ("service_date", "tool_filter"): ("visit_date", "date", "dos", "transaction_date"),
    ("bill_date", "default"): (
        "bill_date", "billdate", "billed_date", "claim_date", "submission_date"),
    ("created_date", "default"): (
        "visit_created_date", "visitcreateddate", "created_date", "date_created"),
    ("transaction_date", "default"): (
        "transaction_date", "transactiondate", "payment_date", "date_created"),
    ("denial", "default"): ("code_description", "codedescription", "denial_description"),
    ("state", "default"): ("state", "facility_state"),
    ("bucket_31_60", "default"): ("ar_31_60", "ar_31_60_days", "ar_bucket_31_60", "aging_31_60"),
    ("bucket_60_plus", "default"): (
        "ar_60_plus", "ar_60+", "ar_60_days", "ar_over_60", "ar_bucket_60_plus", "aging_60_plus"),
}


def resolve(columns: Iterable[str], role: str, context: str = "default") -> str | None:
    """First candidate present among ``columns``; None if there is none."""
    present = set(columns)
    return next((name for name in CANDIDATES[(role, context)] if name in present), None)
