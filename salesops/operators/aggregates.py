"""Grouped measures the reports are built from.

Every aggregate is pre-computed on its own key before it is joined (the
reports do the same by hand), and all of them are sums, counts or maxima, so
Spark runs them as partial (map-side) plus final hash aggregation: a hot key
is collapsed in each map task before the shuffle and cannot overload one
reducer.  Fact tables keyed by customer (invoices, payments, GL, journal
lines) are first reduced to one row per party, so every later join on the
party key sees at most one row per key from each side.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LEAD_HEAT, OPPORTUNITY_STAGES
from ..functions.dates import DateLike, as_date, same_month, same_week
from .filters import product_line
from .joins import anti_join, not_in_subquery, semi_join


def _sum_when(cond: Column, value: Column | str) -> Column:
    """``SUM(CASE WHEN cond THEN value ELSE 0 END)``."""
    v = F.col(value) if isinstance(value, str) else value
    return F.sum(F.when(cond, v).otherwise(F.lit(0)))


# -- funnel -----------------------------------------------------------------

def open_leads_by_heat(lead: DataFrame, opportunity: DataFrame, customer: DataFrame, line: str) -> DataFrame:
    """Leads of the product line with no opportunity and no customer, by owner,
    split by heat (Hot/Warm/Cold and unmarked = NULL or blank)."""
    hot, warm, cold = LEAD_HEAT
    leads = product_line(lead, line).select("name", "lead_owner", "hwc")
    leads = anti_join(leads, opportunity, "name", "party_name")
    leads = anti_join(leads, customer, "name", "lead_name")
    name, hwc = F.col("name"), F.col("hwc")
    return leads.groupBy(F.col("lead_owner").alias("bd")).agg(
        F.count(name).alias("open_leads"),  # ``name`` is the key of leads
        F.count(F.when(hwc == hot, name)).alias("hot_leads"),
        F.count(F.when(hwc == warm, name)).alias("warm_leads"),
        F.count(F.when(hwc == cold, name)).alias("cold_leads"),
        F.count(F.when(hwc.isNull() | (hwc == ""), name)).alias("not_marked_leads"),
    )


def opportunity_counts_by_party(opportunity: DataFrame) -> DataFrame:
    """Per lead (``party_name``): opportunity rows, named opportunities, and
    named opportunities per stage."""
    name, act = F.col("name"), F.col("activity_")
    return opportunity.where(F.col("party_name").isNotNull()).groupBy("party_name").agg(
        F.count(F.lit(1)).alias("opportunity_rows"),
        F.count(name).alias("opportunity_leads"),
        *[F.count(F.when(act == stage, name)).alias(col) for stage, col in OPPORTUNITY_STAGES],
    )


def opportunity_stage_pivot(lead: DataFrame, opportunity: DataFrame, customer: DataFrame, line: str) -> DataFrame:
    """Opportunities of product-line leads that have not become customers, by
    lead owner: total plus one count per stage.  Opportunities are counted per
    lead first, so a lead with very many opportunities is one row in the join."""
    counts = opportunity_counts_by_party(opportunity)
    leads = product_line(lead, line).select("name", "lead_owner")
    leads = anti_join(leads, customer, "name", "lead_name")
    joined = leads.join(counts, leads["name"] == counts["party_name"])
    cols = ["opportunity_leads"] + [c for _, c in OPPORTUNITY_STAGES]
    return joined.groupBy(F.col("lead_owner").alias("bd")).agg(*[F.sum(c).alias(c) for c in cols])


def customer_onboarding(customer: DataFrame, line: str, as_of: DateLike) -> DataFrame:
    """Per account manager: last onboarding date, days since, customer count."""
    c = product_line(customer, line)
    g = c.groupBy(F.col("account_manager").alias("bd")).agg(
        F.max(F.to_date("creation")).alias("last_onboarding_date"),
        F.count("name").alias("total_customers"),
    )
    return g.select("bd", F.datediff(as_date(as_of), F.col("last_onboarding_date")).alias("days_since_last_onboarding"),
                    "last_onboarding_date", "total_customers")


def zero_order_customers(lead: DataFrame, opportunity: DataFrame, customer: DataFrame, sales_order: DataFrame,
                         line: str, as_of: DateLike, excluded_contacts: Sequence[str] | None = None) -> DataFrame:
    """Customers of product-line leads that had an opportunity and never placed
    a sales order.

    The reports join lead x opportunity x customer, so a customer appears once
    per opportunity of its lead; that multiplicity is kept as
    ``opportunity_rows`` instead of materialising repeated rows.
    ``excluded_contacts``: customers whose primary contact is listed, or NULL,
    are dropped (``NOT IN``).
    """
    counts = opportunity_counts_by_party(opportunity).select("party_name", "opportunity_rows")
    leads = product_line(lead, line).select(F.col("name").alias("lead_id"))
    leads = leads.join(counts, F.col("lead_id") == F.col("party_name")).drop("party_name")
    cust = customer.select(F.col("name").alias("customer_id"), "customer_name", "payment_type", "account_manager",
                           "lead_name", "customer_primary_contact", "creation")
    j = leads.join(cust, F.col("lead_id") == F.col("lead_name")).drop("lead_name")
    j = anti_join(j, sales_order.where(F.col("name").isNotNull()), "customer_id", "customer")
    if excluded_contacts is not None:
        j = j.where(~F.col("customer_primary_contact").isin(list(excluded_contacts)))
    onboard = F.to_date("creation")
    return j.select(F.col("account_manager").alias("bd"), "customer_id", "customer_name", "payment_type",
                    onboard.alias("onboarding_date"),
                    F.datediff(as_date(as_of), onboard).alias("days_since_last_onboarding"),
                    "lead_id", "opportunity_rows")


def zero_order_counts(zero_order: DataFrame) -> DataFrame:
    """``COUNT(lead)`` over the lead x opportunity x customer rows, by manager."""
    return zero_order.groupBy("bd").agg(
        F.sum(F.when(F.col("lead_id").isNotNull(), F.col("opportunity_rows"))).alias("customers_0_orders"))


# -- receivables ------------------------------------------------------------

def ledger_balance(gl_entry: DataFrame, journal_entry: DataFrame, ledger_start) -> DataFrame:
    """``SUM(debit - credit)`` by customer party over GL entries created on or
    after ``ledger_start`` with a counter-account, excluding entries whose
    voucher is a journal that is not submitted.  GL ``name`` is the key, so the
    reports' ``name NOT IN (...)`` over a second GL scan is this anti join."""
    # the cut-off is wall-clock time in the session's time zone, like the stored
    # timestamps (a Python datetime literal would be read in the driver's zone)
    start = F.lit(str(ledger_start)).cast("timestamp")
    gl = gl_entry.where((F.col("creation") >= start) & F.col("against").isNotNull()
                        & F.col("party").isNotNull() & (F.col("party_type") == "Customer"))
    unposted = journal_entry.where(F.col("docstatus") != 1).select("name")
    # rows, not per-voucher sums: a voucher seldom has many lines of one party, so
    # grouping first would only shuffle the ledger once more, and adaptive
    # execution can split the left side of an anti join or broadcast the list
    kept = anti_join(gl.select("voucher_no", "party", "debit", "credit"), unposted, "voucher_no", "name")
    return kept.groupBy("party").agg(F.sum(F.col("debit") - F.col("credit")).alias("total_gl_amount"))


def journal_adjustments(journal_entry: DataFrame, journal_entry_account: DataFrame,
                        voucher_types: Sequence[str]) -> DataFrame:
    """``SUM(credit - debit)`` by customer party over submitted, unallocated
    lines of submitted journals of the listed voucher types."""
    je = journal_entry.where(F.col("voucher_type").isin(list(voucher_types)) & (F.col("docstatus") == 1))
    lines = journal_entry_account.where((F.col("party_type") == "Customer") & F.col("party").isNotNull()
                                        & (F.col("docstatus") == 1) & F.col("reference_type").isNull())
    lines = semi_join(lines.select("parent", "party", "credit", "debit"), je, "parent", "name")
    return lines.groupBy("party").agg(F.sum(F.col("credit") - F.col("debit")).alias("total_jv_amount"))


def payment_party_totals(payment_entry: DataFrame, as_of: DateLike) -> DataFrame:
    """One pass over submitted payments, by party: the unallocated total, and
    collections of yesterday / this week / this month (status Submitted only,
    by creation date)."""
    a = as_of if isinstance(as_of, _dt.date) else as_date(as_of)
    pe = payment_entry.where(F.col("party").isNotNull() & (F.col("docstatus") == 1))
    sub = F.col("status") == "Submitted"
    d = F.to_date("creation")
    paid = F.col("paid_amount")

    def coll(cond: Column) -> Column:
        return F.sum(F.when(sub, F.when(cond, paid).otherwise(F.lit(0))))

    return pe.groupBy("party").agg(
        F.count_if(sub).alias("n_collections"),
        coll(d == F.date_sub(as_date(a), 1)).alias("yesterday_collection"),
        coll(same_week(d, a)).alias("week_collection"),
        coll(same_month(d, a)).alias("month_collection"),
        F.sum("unallocated_amount").alias("total_unallocated_amount"),
    )


def unallocated_payments(party_totals: DataFrame) -> DataFrame:
    return party_totals.select("party", "total_unallocated_amount")


def collections_by_manager(party_totals: DataFrame, customer: DataFrame) -> DataFrame:
    """Collections by the party's account manager (NULL when the party is not a
    customer); only parties with at least one submitted collection count."""
    p = party_totals.where(F.col("n_collections") > 0)
    c = customer.select(F.col("name").alias("__c"), "account_manager")
    j = p.join(c, F.col("party") == F.col("__c"), "left")
    return j.groupBy("account_manager").agg(
        F.sum("yesterday_collection").alias("amount"),
        F.sum("week_collection").alias("week_collection"),
        F.sum("month_collection").alias("month_collection"),
    )


def excluded_parties(party_account: DataFrame, accounts: Sequence[str]) -> DataFrame:
    """Distinct customers booked on an excluded receivable account."""
    return party_account.where(F.col("account").isin(list(accounts))).select(
        F.col("parent").alias("customer_code")).distinct()


def eligible_customers(customer: DataFrame, party_account: DataFrame, accounts: Sequence[str]) -> DataFrame:
    """Customers without an OMC dealer code and not on an excluded account
    (SQL ``NOT IN``: a NULL in the list excludes everyone)."""
    c = customer.where(F.col("custom_omc_dealer_code").isNull())
    return not_in_subquery(c, "name", excluded_parties(party_account, accounts), "customer_code", key=True)


def invoice_day_totals(sales_invoice: DataFrame) -> DataFrame:
    """Submitted invoices reduced to one row per customer and posting date:
    their outstanding and count (hash aggregation, partial before the shuffle)."""
    return sales_invoice.where(F.col("docstatus") == 1).groupBy("customer", "posting_date").agg(
        F.sum("outstanding_amount").alias("day_outstanding"), F.count(F.lit(1)).alias("day_submitted"))


def customer_invoice_sums(sales_invoice: DataFrame, customers: DataFrame, as_of: DateLike,
                          terms_col: str = "payment_terms_days", carry: Sequence[str] = ("account_manager",)) -> DataFrame:
    """Per eligible customer with a submitted invoice: total outstanding,
    overdue (posted on or before ``as_of - terms``), falling due tomorrow,
    falling due within 1..7 days.

    ``customers`` carries ``name``, ``terms_col`` and the ``carry`` columns
    (passed through per customer).  Invoices are first reduced per customer
    and day, so the join with customers sees at most one row per
    customer-day however many invoices a customer has.
    """
    from ..functions.numeric import due_cutoff

    a = as_date(as_of)
    days = invoice_day_totals(sales_invoice)
    c = customers.select(F.col("name").alias("customer_id"), terms_col, *carry)
    j = days.join(c, F.col("customer") == F.col("customer_id"))
    pd, out, terms = F.col("posting_date"), F.col("day_outstanding"), F.col(terms_col)
    cut0, cut1, cut7 = due_cutoff(a, terms, 0), due_cutoff(a, terms, 1), due_cutoff(a, terms, 7)
    return j.groupBy("customer_id", *carry).agg(
        F.sum(out).alias("outstanding_amount"),
        _sum_when(pd <= cut0, out).alias("overdue_gross"),
        _sum_when(pd == cut1, out).alias("due_tomorrow_gross"),
        _sum_when(pd.between(cut1, cut7), out).alias("due_week_gross"))


def customers_per_manager(customer: DataFrame) -> DataFrame:
    """Customers by account manager; ``name`` is the table's key, so no name counts twice."""
    return customer.groupBy("account_manager").agg(F.count("name").alias("customer_count"))


def outstanding_by_manager(sales_invoice: DataFrame, customer: DataFrame) -> DataFrame:
    """All invoices' outstanding by the customer's account manager (no state filter)."""
    per_customer = sales_invoice.groupBy("customer").agg(F.sum("outstanding_amount").alias("o"))
    c = customer.select(F.col("name").alias("__c"), "account_manager")
    j = per_customer.join(c, F.col("customer") == F.col("__c"), "left")
    return j.groupBy("account_manager").agg(F.sum("o").alias("outstanding_amount"))


def last_payment_date(payment_entry: DataFrame) -> DataFrame:
    return payment_entry.groupBy(F.col("party").alias("customer")).agg(
        F.max("posting_date").alias("last_payment_entry_date"))


# -- achievements -----------------------------------------------------------

def daily_achievement_sums(daily: DataFrame, as_of: DateLike) -> DataFrame:
    a = as_date(as_of)
    return daily.groupBy("bd", "sales_target").agg(
        _sum_when(F.col("date") == F.date_sub(a, 1), "daily_achievement").alias("yesterday_achievement"),
        _sum_when(F.col("date") == a, "daily_achievement").alias("today_achievement"),
    )


def weekly_achievement_sums(weekly: DataFrame, as_of: DateLike) -> DataFrame:
    return weekly.groupBy("bd", "sales_target").agg(
        _sum_when(same_week("date", as_of), "weekly_achievement").alias("week_till_date_achievement"))


def monthly_achievement_sums(monthly: DataFrame, as_of: DateLike) -> DataFrame:
    return monthly.groupBy("bd", "sales_target").agg(
        _sum_when(same_month("date", as_of), "monthly_achievement").alias("month_till_date_achievement"))


def zonal_targets(zonal: DataFrame) -> DataFrame:
    return zonal.groupBy("parent", "zonal_head").agg(F.sum("zones_target").alias("zones_target"))


# -- appointments -----------------------------------------------------------

def open_todo_count(todo: DataFrame, as_of: DateLike, months: int = 2) -> DataFrame:
    from .filters import open_recent_todos
    return open_recent_todos(todo, as_of, months).groupBy("owner").agg(F.count(F.lit(1)).alias("Count_Status_Open"))


def funnel_metrics(lead: DataFrame, opportunity: DataFrame, customer: DataFrame, sales_order: DataFrame,
                   line: str) -> DataFrame:
    """Open leads by heat, opportunity stages and zero-order counts per bd in
    one pass over leads, opportunities, customers and sales orders.

    Opportunities are counted per lead, customers per (lead, manager) with
    how many have no sales order; leads are left-joined to both (each side
    already reduced on the join key, so a lead with very many opportunities
    or customers is a handful of rows).  One aggregation over ``GROUPING
    SETS ((lead_owner), (account_manager))`` then yields the lead-owner
    measures (leads without a customer) and the manager measures (lead x
    opportunity x customer rows without an order), combined per bd.

    Same result as ``open_leads_by_heat``, ``opportunity_stage_pivot`` and
    ``zero_order_counts`` joined on bd.
    """
    hot, warm, cold = LEAD_HEAT
    counts = opportunity_counts_by_party(opportunity)
    leads = product_line(lead, line).select("name", "lead_owner", "hwc")
    leads = leads.join(counts, leads["name"] == counts["party_name"], "left").drop("party_name")
    ordered = sales_order.where(F.col("name").isNotNull() & F.col("customer").isNotNull()).select(
        F.col("customer").alias("__so")).distinct()
    cust = customer.where(F.col("lead_name").isNotNull()).select("name", "lead_name", "account_manager")
    cust = cust.join(ordered, cust["name"] == ordered["__so"], "left")
    per_lead = cust.groupBy("lead_name", "account_manager").agg(
        F.count(F.lit(1)).alias("__customers"), F.count_if(F.col("__so").isNull()).alias("__no_order"))
    rows = leads.join(per_lead, leads["name"] == per_lead["lead_name"], "left")

    has_opp = F.col("opportunity_rows").isNotNull()
    no_cust = F.col("lead_name").isNull()
    open_ = no_cust & ~has_opp
    stage = no_cust & has_opp
    name, hwc = F.col("name"), F.col("hwc")
    stage_cols = ["opportunity_leads"] + [c for _, c in OPPORTUNITY_STAGES]
    g = rows.groupingSets([["lead_owner"], ["account_manager"]], "lead_owner", "account_manager").agg(
        F.grouping_id().alias("__gid"),
        F.count_if(open_).alias("__open"),
        F.count(F.when(open_, name)).alias("open_leads"),
        F.count(F.when(open_ & (hwc == hot), name)).alias("hot_leads"),
        F.count(F.when(open_ & (hwc == warm), name)).alias("warm_leads"),
        F.count(F.when(open_ & (hwc == cold), name)).alias("cold_leads"),
        F.count(F.when(open_ & (hwc.isNull() | (hwc == "")), name)).alias("not_marked_leads"),
        *[F.sum(F.when(stage, F.col(c))).alias(c) for c in stage_cols],
        F.sum(F.when(has_opp & (F.col("__no_order") > 0),
                     F.col("opportunity_rows") * F.col("__no_order"))).alias("customers_0_orders"))
    by_owner = F.col("__gid") == 1          # grouped by lead_owner (account_manager rolled up)
    open_cols = ["open_leads", "hot_leads", "warm_leads", "cold_leads", "not_marked_leads"]
    g = g.select(F.when(by_owner, F.col("lead_owner")).otherwise(F.col("account_manager")).alias("bd"),
                 *[F.when(by_owner & (F.col("__open") > 0), F.col(c)).alias(c) for c in open_cols],
                 *[F.when(by_owner, F.col(c)).alias(c) for c in stage_cols],
                 F.when(~by_owner, F.col("customers_0_orders")).alias("customers_0_orders"))
    return g.groupBy("bd").agg(*[F.max(c).alias(c) for c in open_cols + stage_cols + ["customers_0_orders"]])
