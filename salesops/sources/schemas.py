"""Column contract of the CRM tables the reports read.

Types follow how the reports use each column: money and quantities are exact
decimals, flags are ints, ``posting_time`` is seconds of the day.  Tables are
always read with these schemas; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(21, 9)
S, D, I, L, TS = T.StringType(), T.DateType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "sales_target": _schema(("name", S), ("business_head", S), ("sales_person", S), ("posting_date", D)),
    "business_developer": _schema(
        ("parent", S), ("bd", S), ("bd_sales_person", S), ("zonal_head", S),
        ("zonal_head_sales_person", S), ("daily_targerts", MONEY), ("weekly_targets", MONEY),
        ("monthly_targets", MONEY)),
    "sales_person": _schema(("name", S), ("custom_user", S), ("custom_team", S)),
    "customer": _schema(
        ("name", S), ("customer_name", S), ("account_manager", S), ("custom_team", S),
        ("lead_name", S), ("payment_terms", S), ("payment_type", S), ("transaction_type", S),
        ("custom_omc_dealer_code", S), ("customer_primary_contact", S), ("creation", TS)),
    "lead": _schema(("name", S), ("company_name", S), ("lead_owner", S), ("transaction_type", S), ("hwc", S)),
    "opportunity": _schema(("name", S), ("party_name", S), ("customer_name", S), ("activity_", S)),
    "sales_order": _schema(("name", S), ("customer", S)),
    "sales_invoice": _schema(
        ("name", S), ("sales_order", S), ("customer", S), ("posting_date", D), ("posting_time", L),
        ("outstanding_amount", MONEY), ("status", S), ("docstatus", I), ("shipping_address_name", S)),
    "payment_entry": _schema(
        ("name", S), ("party", S), ("posting_date", D), ("creation", TS), ("paid_amount", MONEY),
        ("unallocated_amount", MONEY), ("docstatus", I), ("status", S)),
    "gl_entry": _schema(
        ("name", S), ("party", S), ("party_type", S), ("against", S), ("voucher_no", S),
        ("creation", TS), ("debit", MONEY), ("credit", MONEY)),
    "journal_entry": _schema(("name", S), ("voucher_type", S), ("docstatus", I)),
    "journal_entry_account": _schema(
        ("parent", S), ("party", S), ("party_type", S), ("reference_type", S), ("docstatus", I),
        ("credit", MONEY), ("debit", MONEY)),
    "party_account": _schema(("parent", S), ("account", S)),
    "customer_credit_limit": _schema(("parent", S), ("credit_limit", MONEY), ("bypass_credit_limit_check", I)),
    "address": _schema(("name", S), ("city", S)),
    "daily_achievement": _schema(
        ("bd", S), ("sales_target", S), ("date", D), ("daily_target", MONEY),
        ("daily_achievement", MONEY), ("daily_achievement_sales_order", MONEY), ("collection", MONEY)),
    "weekly_achievement": _schema(
        ("bd", S), ("sales_target", S), ("date", D), ("weekly_target", MONEY),
        ("weekly_achievement", MONEY), ("daily_achievement_sales_order", MONEY), ("collection", MONEY)),
    "monthly_achievement": _schema(
        ("bd", S), ("sales_target", S), ("date", D), ("monthly_target", MONEY),
        ("monthly_achievement", MONEY), ("daily_achievement_sales_order", MONEY), ("collection", MONEY)),
    "quaterly_achievement": _schema(
        ("bd", S), ("sales_target", S), ("date", D), ("quaterly_target", MONEY),
        ("quaterly_achievement", MONEY), ("quaterly_achievement_sales_order", MONEY), ("collection", MONEY)),
    "zonal": _schema(("parent", S), ("zonal_head", S), ("zones_target", MONEY)),
    "todo": _schema(
        ("name", S), ("owner", S), ("date", D), ("status", S), ("reference_type", S), ("reference_name", S)),
    "event_participants": _schema(("parent", S), ("idx", I), ("reference_docname", S)),
}

# Document-type name of each table on a live site (``tab<DocType>``).
DOCTYPES: dict[str, str] = {
    "sales_target": "Sales Target",
    "business_developer": "Business Deverloper",
    "sales_person": "Sales Person",
    "customer": "Customer",
    "lead": "Lead",
    "opportunity": "Opportunity",
    "sales_order": "Sales Order",
    "sales_invoice": "Sales Invoice",
    "payment_entry": "Payment Entry",
    "gl_entry": "GL Entry",
    "journal_entry": "Journal Entry",
    "journal_entry_account": "Journal Entry Account",
    "party_account": "Party Account",
    "customer_credit_limit": "Customer Credit Limit",
    "address": "Address",
    "daily_achievement": "Daily Achievement",
    "weekly_achievement": "Weekly Achievement",
    "monthly_achievement": "Monthly Achievement",
    "quaterly_achievement": "Quaterly Achievement",
    "zonal": "Zonal",
    "todo": "ToDo",
    "event_participants": "Event Participants",
}

TABLES = tuple(SCHEMAS)
