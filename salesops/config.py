"""Report parameters.

Everything the reports take from outside the data lives in one frozen
``Config``: the reporting date, the ledger cut-off, the exclusion lists, the
price factor and the product line.  Reports never read the wall clock on their
own; pass ``as_of`` to make a run reproducible.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, replace
from decimal import Decimal

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the values the reports were specified with,
# or results differ.  They are kept here as plain text, in their original
# order (duplicates included), and used as the defaults of ``Config``.
# ---------------------------------------------------------------------------

# Sales persons hidden from the appointment and debtor reports.
EXCLUDED_SALES_PERSONS: tuple[str, ...] = (
    "Abhishek Anand", "Ankur Goel", "Narayan Sathe",
    "Nora Bali", "Palash Gupta", "Ravi",
    "SK Arora", "Setu Joshi", "Vadivel Nandhyalam",
)

# Primary contacts whose customers never count as zero-order customers
# (46 entries, 42 distinct).
EXCLUDED_CONTACTS: tuple[str, ...] = (
    "CON-ERP-FY-09064", "CON-APP-FY-04429", "CON-APP-FY-04237",
    "CON-APP-FY-04431", "CON-APP-FY-04301", "CON-APP-FY-04457",
    "CON-APP-FY-04675", "CON-ERP-FY-23654", "CON-APP-FY-000005783",
    "CON-APP-FY-04664", "CON-APP-FY-04609", "CON-ERP-FY-09065",
    "CON-APP-FY-04469", "CON-APP-FY-04237", "CON-APP-FY-04431",
    "CON-APP-FY-04454", "CON-ERP-FY-000024587", "CON-ERP-FY-000024581",
    "CON-ERP-FY-20282", "CON-ERP-FY-20283", "CON-ERP-FY-20284",
    "CON-ERP-FY-000024582", "CON-ERP-FY-20277", "CON-ERP-FY-000024811",
    "CON-ERP-FY-000024810", "CON-ERP-FY-000024809", "CON-APP-FY-000006607",
    "CON-ERP-FY-20282", "CON-ERP-FY-20284", "CON-ERP-FY-000024649",
    "CON-ERP-FY-20279", "CON-ERP-FY-000024586", "CON-ERP-FY-20288",
    "CON-ERP-FY-000024583", "CON-ERP-FY-000024584", "CON-ERP-FY-20281",
    "CON-ERP-FY-20285", "CON-ERP-FY-10671", "CON-ERP-FY-000024332",
    "CON-APP-FY-04304", "CON-APP-FY-000017976", "CON-ERP-FY-000024852",
    "CON-ERP-FY-000024836", "CON-APP-FY-000009809", "CON-ERP-FY-000024346",
    "CON-ERP-FY-000024702",
)

# Receivable accounts whose customers are left out of outstanding/overdue.
EXCLUDED_RECEIVABLE_ACCOUNTS: tuple[str, ...] = (
    "Trade Receivable for Inactive - TSL",
    "Trade Receiavable for Franchisee - TSL",
)

# Journal voucher types whose unallocated customer lines count as adjustments.
JOURNAL_VOUCHER_TYPES: tuple[str, ...] = (
    "Bank Entry",
    "Cash Entry",
    "Credit Card Entry",
    "Debit Note",
    "Credit Note",
    "Contra Entry",
    "Excise Entry",
    "Write Off Entry",
    "Opening Entry",
    "Depreciation Entry",
    "Exchange Rate Revaluation",
    "Exchange Gain Or Loss",
    "Deferred Revenue",
    "Deferred Expense",
    "Reversal Of ITC",
    "Inter Company Journal Entry",
    "Journal Entry",
)

# Opportunity stages, in funnel order, with the output column of each.
OPPORTUNITY_STAGES: tuple[tuple[str, str], ...] = (
    ("1.In Discussion Meeting Pending", "In_Discussion_Meeting_Pending"),
    ("2.Meeting Scheduled", "Meeting_Scheduled"),
    ("3.In Negotitation", "In_Negotitation"),
    ("4.Finance Approval Pending", "Finance_Approval_Pending"),
    ("5.Ops Submission Pending", "Ops_Submission_Pending"),
    ("6.Ops Approval Pending", "Ops_Approval_Pending"),
    ("7.Ops approved- Finance closure Pending", "Ops_approved_Finance_closure_Pending"),
    ("8.Lost", "Lost"),
    ("9.On-boarded", "Onboarded"),
)

# Lead heat labels.
LEAD_HEAT: tuple[str, ...] = ("Hot", "Warm", "Cold")

# Dashboard categories, in report order.
DASHBOARD_CATEGORIES: tuple[str, ...] = ("Orders", "Deliveries", "Collection")

# Shown columns of each report: column, label, display type.
REPORT_FIELDS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "appointment": (
        ("Team", "Team Name", "Data"), ("BD", "BD Name", "Data"), ("Zonal_head", "Zonal Head", "Data"),
        ("Todo_ID", "Todo ID", "Data"), ("Appointment_type", "Appointment Type", "Data"),
        ("Reference_Type", "Reference Type", "Data"), ("Yesterday", "Yesterday", "Data"), ("Today", "Today", "Data"),
        ("Week", "Week", "Data"), ("Count_Status_Open", "Count Status Open ", "Data"),
    ),
    "collection": (
        ("team", "Team", "Data"), ("bd_name", "AE", "Data"),
        ("net_outstanding_amount", "Outstanding (Rs) Lacs", "Currency"),
        ("net_overdue_amount", "Overdue (Rs) Lacs", "Currency"),
        ("lwd_tgt", "LWD TGT (Rs) Cr", "Float"), ("lwd_actual", "Actual Cr", "Float"),
        ("lwd_att", "LWD Att %", "Percent"), ("week_tgt", "Week TGT (Rs) Cr", "Float"),
        ("wtd_tgt", "WTD TGT", "Float"), ("Week_Actual", "Actual Cr", "Float"),
        ("week_att", "Weekly Att (%)", "Percent"), ("Month_TGT", "Month TGT", "Float"),
        ("mtd_tgt", "MTD TGT", "Float"), ("MTD_Actual", "Actual Cr", "Float"),
        ("month_att", "MTD Att (%)", "Percent"),
    ),
    "dashboard": (
        ("custom_team", "Team", "Data"), ("zonal_head_sales_person", "Zonal Head", "Data"),
        ("bd_sales_person", "BD", "Data"), ("Category", "Category", "Data"),
        ("LWD_Target", "LWD Target", "Float"), ("LWD_Actual", "LWD Achv.", "Float"),
        ("WTD_Target", "WTD Target", "Float"), ("WTD_Actual", "WTD Achv.", "Float"),
        ("MTD_Target", "MTD Target", "Float"), ("MTD_Actual", "MTD Achv.", "Float"),
        ("QTD_Target", "QTD Target", "Float"), ("QTD_Actual", "QTD Achv.", "Float"),
    ),
    "debtors": (
        ("Team", "Team", "Data"), ("Team_Username", "BD", "Data"),
        ("zonal_head_sales_person", "Zonal Head Sales Person", "Data"), ("zonal_head", "Zonal Head", "Data"),
        ("customer_id", "Customer ID", "Data"), ("customer_name", "Customer Name", "Data"),
        ("customer_payment_type", "Payment Type", "Data"), ("credit_limit", "Credit Limit", "Currency"),
        ("payment_terms", "Payment Terms", "Int"), ("last_delivery_city", "Last Delivery City", "Data"),
        ("allowed_credit_breach", "Credit Breach", "Data"), ("ledger", "Ledger", "Currency"),
        ("net_outstanding", "Net Outstanding", "Currency"), ("net_overdue", "Net Overdue", "Currency"),
        ("overdue_amount_tomorrow", "Overdue Amount Tomorrow", "Currency"),
        ("overdue_amount_this_week", "Overdue Amount This Week", "Currency"),
    ),
    "funnel": (
        ("Team", "Team Name", "Data"), ("zonal_head_sales_person", "Zonal Head", "Data"), ("BD", "BD Name", "Data"),
        ("open_leads", "Open Leads", "Data"), ("hot_leads", "Hot Leads", "Data"), ("warm_leads", "Warm Leads", "Data"),
        ("cold_leads", "Cold Leads", "Data"), ("not_marked_leads", "Not Marked", "Data"),
        ("opportunity_leads", "Opportunity Leads", "Data"),
        ("In_Discussion_Meeting_Pending", "In discussion meeting pending ", "Data"),
        ("Meeting_Scheduled", "Meeting scheduled", "Data"), ("In_Negotitation", "In negotiation", "Data"),
        ("Finance_Approval_Pending", "Finance approval pending", "Data"),
        ("Ops_Submission_Pending", "Ops submission pending", "Data"),
        ("Ops_Approval_Pending", "Ops approval pending", "Data"),
        ("Ops_approved_Finance_closure_Pending", "Ops approved finance closure pending", "Data"),
        ("Lost", "Lost", "Data"), ("Onboarded", "Onboarded", "Data"),
        ("days_since_last_onboarding", "Days since last onboarding", "Data"),
        ("customers_0_orders", "Customers with 0 orders", "Data"),
    ),
    "zero_order": (
        ("team", "Team", "Data"), ("team_username", "BD", "Data"), ("zonal_head_sales_person", "Zonal Head", "Data"),
        ("customer_id", "Customer ID", "Data"), ("customer_name", "Customer Name", "Data"),
        ("payment_type", "Payment Type", "Data"), ("days_since_last_onboarding", "Days Since Onboarding", "Int"),
    ),
}

# Product line of the funnel and zero-order reports.
PRODUCT_LINE = "High Speed Diesel"

# Ledger cut-off of the receivable reports.
LEDGER_START = _dt.date(2024, 4, 1)

# Price factor applied to quantity targets.
UNIT_PRICE = 90

# Payment type of the debtor report.
POSTPAID = "Postpaid"

# Unit scaling: one lakh and one crore, as exact multipliers.
PER_LAKH = Decimal("0.00001")
PER_CRORE = Decimal("0.0000001")


@dataclass(frozen=True)
class Config:
    """Parameters shared by every report.

    ``as_of`` replaces the database's ``CURRENT_DATE``; ``None`` means the
    session's ``current_date()``.
    """

    as_of: _dt.date | None = None
    ledger_start: _dt.date = LEDGER_START
    excluded_sales_persons: tuple[str, ...] = EXCLUDED_SALES_PERSONS
    excluded_contacts: tuple[str, ...] = EXCLUDED_CONTACTS
    excluded_accounts: tuple[str, ...] = EXCLUDED_RECEIVABLE_ACCOUNTS
    journal_voucher_types: tuple[str, ...] = JOURNAL_VOUCHER_TYPES
    product_line: str = PRODUCT_LINE
    unit_price: int = UNIT_PRICE
    # Quirk switches; defaults reproduce the reports as specified.
    fix_lwd_att: bool = False
    per_customer_pools: bool = False
    # Compare user ids without regard to case, as a case-insensitive database does.
    ignore_case: bool = False

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)
