"""Registered queries for the operators the reports are built from.

Each exercises one operator of the inventory on the whole fixture tables,
through the same library functions the reports use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DASHBOARD_CATEGORIES
from ..functions import dates as D
from ..functions import numeric as N
from ..operators import aggregates as A
from ..operators import metrics as M
from ..operators.filters import (exclude_values, on_or_after, open_recent_todos, product_line, submitted,
                                 visible_to, with_status)
from ..operators.joins import anti_join, ci_key, not_in_subquery
from ..operators.output import category_rank
from ..operators.star import star_max
from ..operators.windows import one_row_per_key, pick_one, row_number_split
from ..sources.schemas import SCHEMAS
from . import reports as R
from .catalog import register
from .params import AS_OF, CONFIG, EXCLUDED_PERSONS, LEDGER_START, TODO_AS_OF, TODO_CONFIG, VISIBLE_USER

# -- sources and sinks ----------------------------------------------------------


@register("source_row_counts")
def source_row_counts(t):
    """Row count of every CRM table."""
    parts = [t[n].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n in SCHEMAS]
    return reduce(DataFrame.unionByName, parts)


def _total_row(name: str, config) -> None:
    key = "report_total_row" if name == "collection" else f"report_total_row_{name}"

    @register(key)
    def run(t):
        return R.with_totals(name, R.REPORTS[name](t, None, config))

    run.__doc__ = f"S5: the {name} report with the viewer's total row appended."


for _name in R.REPORTS:
    _total_row(_name, TODO_CONFIG if _name == "appointment" else CONFIG)


# -- filters ----------------------------------------------------------------------


@register("row_visibility")
def row_visibility(t):
    """Latest-plan developers visible to one business head."""
    sp = visible_to(R.plan_bd_spine(t), VISIBLE_USER)
    return sp.select("plan", "business_head", "bd", "zonal_head")


@register("latest_sales_target")
def latest_sales_target(t):
    """Latest plan per business head."""
    return R.latest_plans(t["sales_target"]).select("business_head", "name", "posting_date", "sales_person")


@register("exclude_sales_persons")
def exclude_sales_persons(t):
    """Sales persons minus the excluded names."""
    return R.teams(t["sales_person"], EXCLUDED_PERSONS)


@register("exclude_contacts_null_drop")
def exclude_contacts_null_drop(t):
    """Customers whose primary contact is not excluded (NULL contact dropped)."""
    return exclude_values(t["customer"], "customer_primary_contact", CONFIG.excluded_contacts).select(
        "name", "customer_primary_contact")


@register("party_exclusion_not_in")
def party_exclusion_not_in(t):
    """P5: submitted invoices whose customer is not on an excluded account (SQL NOT IN)."""
    inv = submitted(t["sales_invoice"]).select(F.col("name").alias("invoice_id"), "customer")
    cust = t["customer"].select(F.col("name").alias("customer_id"))
    j = inv.join(cust, F.col("customer") == F.col("customer_id"), "left")
    return not_in_subquery(j, "customer_id", A.excluded_parties(t["party_account"], CONFIG.excluded_accounts),
                           "customer_code").select("invoice_id", "customer_id")


@register("gl_excluding_unposted_journals")
def gl_excluding_unposted_journals(t):
    """GL entries since the cut-off whose voucher is not an unposted journal."""
    gl = on_or_after(t["gl_entry"], "creation", LEDGER_START)
    unposted = t["journal_entry"].where(F.col("docstatus") != 1).select(F.col("name").alias("__je"))
    return gl.join(unposted, F.col("voucher_no") == F.col("__je"), "left_anti").select("name", "party", "voucher_no")


@register("ledger_cutoff")
def ledger_cutoff(t):
    """GL entries created on or after the cut-off, by party type."""
    gl = on_or_after(t["gl_entry"], "creation", LEDGER_START)
    return gl.groupBy("party_type").agg(F.count(F.lit(1)).alias("entries"), F.sum("debit").alias("debit"),
                                        F.sum("credit").alias("credit"))


@register("journal_type_filter")
def journal_type_filter(t):
    """Journals of the listed voucher types."""
    return t["journal_entry"].where(F.col("voucher_type").isin(list(CONFIG.journal_voucher_types)))


@register("submitted_only")
def submitted_only(t):
    """Submitted payments by party."""
    pe = with_status(submitted(t["payment_entry"]), "Submitted")
    return pe.groupBy("party").agg(F.count(F.lit(1)).alias("payments"), F.sum("paid_amount").alias("paid_amount"))


@register("unreferenced_journal_lines")
def unreferenced_journal_lines(t):
    """P10: customer journal lines not allocated to a document."""
    jea = t["journal_entry_account"]
    return jea.where(F.col("reference_type").isNull() & F.col("party").isNotNull()
                     & (F.col("party_type") == "Customer")).select("parent", "party", "credit", "debit")


@register("transaction_type_filter")
def transaction_type_filter(t):
    """Leads of the product line."""
    return product_line(t["lead"], CONFIG.product_line).select("name", "lead_owner")


@register("postpaid_only")
def postpaid_only(t):
    """Customer debt rows of postpaid customers."""
    d = R.customer_debt(t, CONFIG).where(F.col("customer_payment_type") == "Postpaid")
    return d.select("customer_id", "bd", "credit_limit", "ledger", "net_outstanding")


@register("todo_any_bucket")
def todo_any_bucket(t):
    """Todos labelled in at least one day bucket."""
    return R.todo_buckets(t, TODO_AS_OF)


@register("todo_recent_window")
def todo_recent_window(t):
    """Open todos of the last two months."""
    return open_recent_todos(t["todo"], TODO_AS_OF).select("name", "owner", "date")


@register("positive_ledger")
def positive_ledger(t):
    """Parties with a positive ledger balance."""
    return A.ledger_balance(t["gl_entry"], t["journal_entry"], LEDGER_START).where(F.col("total_gl_amount") > 0)


@register("open_posting_date")
def open_posting_date(t):
    """Posting date of invoices that are neither cancelled nor paid."""
    si = t["sales_invoice"]
    return si.select("name", "status", M.open_posting_date(F.col("status"), F.col("posting_date")).alias("posting_date2"))


@register("credit_breach_flag")
def credit_breach_flag(t):
    """Distinct credit limits with the Y/N breach flag."""
    return R.credit_limits(t["customer_credit_limit"]).withColumnRenamed("__ccl", "parent")


@register("team_or_others")
def team_or_others(t):
    """Customer team, 'Others' when missing."""
    c = t["customer"]
    return c.select("name", M.team_or_others(F.col("custom_team")).alias("custom_team"), "account_manager")


@register("appointment_type")
def appointment_type(t):
    """P20: Event/Task label of every todo."""
    td = t["todo"]
    return td.select("name", "reference_type", M.appointment_type(F.col("reference_type")).alias("Appointment_type"))


# -- joins ------------------------------------------------------------------------


@register("plan_bd_spine")
def plan_bd_spine(t):
    """Latest plans with their developers."""
    return R.plan_bd_spine(t).select("plan", "business_head", "plan_date", "bd", "bd_sales_person", "zonal_head",
                                     "daily_targerts")


@register("bd_team_lookup")
def bd_team_lookup(t):
    """Developers of latest plans with their team."""
    sp = R.with_team(R.plan_bd_spine(t), R.teams(t["sales_person"]))
    return sp.select("plan", "bd", "team_user_name", "custom_team")


@register("payments_by_manager")
def payments_by_manager(t):
    """Submitted payments by the customer's account manager."""
    pe = with_status(submitted(t["payment_entry"]), "Submitted").where(F.col("party").isNotNull())
    per_party = pe.groupBy("party").agg(F.sum("paid_amount").alias("paid"), F.count(F.lit(1)).alias("n"))
    c = t["customer"].select(F.col("name").alias("__c"), "account_manager")
    j = per_party.join(c, F.col("party") == F.col("__c"), "left")
    return j.groupBy("account_manager").agg(F.sum("paid").alias("paid_amount"), F.sum("n").alias("payments"))


@register("leads_without_opportunity")
def leads_without_opportunity(t):
    """Leads with no opportunity."""
    return anti_join(t["lead"], t["opportunity"], "name", "party_name").select("name", "lead_owner")


@register("customers_without_orders")
def customers_without_orders(t):
    """Customers with no sales order."""
    return anti_join(t["customer"], t["sales_order"], "name", "customer").select("name", "account_manager")


@register("lead_opportunity_inner")
def lead_opportunity_inner(t):
    """Leads joined to their opportunities (one row per opportunity)."""
    l, o = t["lead"], t["opportunity"]
    return l.join(o, l["name"] == o["party_name"]).select(l["name"].alias("lead"), o["name"].alias("opportunity"),
                                                          "activity_")


@register("achievement_star_max")
def achievement_star_max(t):
    """The dashboard's per-bd maxima (Deliveries) over all plans' developers."""
    bds = R.plan_bd_spine(t, latest=False).where(F.col("bd").isNotNull()).select("bd").distinct()
    s = star_max(bds, R.dashboard_children(t, AS_OF, CONFIG.unit_price))
    return s.select("bd", *[F.col(R._dashboard_cell("Deliveries", m)).alias(m) for m in R.DASHBOARD_MEASURES])


@register("todo_or_join")
def todo_or_join(t):
    """Open todos with the customer / lead / opportunity their reference or first participant names."""
    rows = R.todo_rows(t, TODO_AS_OF)
    return rows.select("name", "reference_name", "ep_reference_docname", "tc_name", "tl_name", "tpo_name")


@register("first_event_participant")
def first_event_participant(t):
    """Every todo with its first event participant."""
    td = t["todo"].select("name", "reference_name")
    ep = t["event_participants"].where(F.col("idx") == 1).select(
        F.col("parent").alias("ep_parent"), F.col("reference_docname").alias("ep_reference_docname"))
    return td.join(ep, td["reference_name"] == ep["ep_parent"], "left")


@register("todo_owner_ci_join")
def todo_owner_ci_join(t):
    """Developers of latest plans with open todos owned case-insensitively."""
    sp = R.plan_bd_spine(t).select("bd")
    td = open_recent_todos(t["todo"], TODO_AS_OF).select("name", "owner")
    return sp.join(td, ci_key(td["owner"]) == ci_key(sp["bd"])).select("bd", "name", "owner")


@register("todo_owner_exact_join")
def todo_owner_exact_join(t):
    """Developers of latest plans with their open-todo count (exact owner)."""
    sp = R.plan_bd_spine(t).select("bd")
    c = A.open_todo_count(t["todo"], TODO_AS_OF)
    j = sp.join(c, sp["bd"] == c["owner"], "left")
    return j.select("bd", F.coalesce(F.col("Count_Status_Open"), F.lit(0)).alias("Count_Status_Open"))


@register("customer_balance_join")
def customer_balance_join(t):
    """Every customer with its ledger, journal and unallocated totals."""
    r = R.receivable_inputs(t, CONFIG)
    c = t["customer"].select("name")
    for part in (r["ledger"], r["adjustments"], r["unallocated"]):
        c = c.join(part, c["name"] == part["party"], "left").drop("party")
    return c


@register("customer_credit_limits")
def customer_credit_limits(t):
    """Customers with their credit limits (one row per limit)."""
    c = t["customer"].select("name")
    ccl = t["customer_credit_limit"]
    return c.join(ccl, c["name"] == ccl["parent"], "left").select("name", "credit_limit", "bypass_credit_limit_check")


@register("last_delivery_city")
def last_delivery_city(t):
    """City of each customer's latest invoice."""
    return R.last_delivery_city(t["sales_invoice"], t["address"])


@register("invoice_self_lookup")
def invoice_self_lookup(t):
    """Submitted invoices with their own outstanding amount."""
    si = submitted(t["sales_invoice"])
    return si.select("name", "status", "outstanding_amount", F.col("outstanding_amount").alias("outstandingAmount"))


@register("bd_metric_join")
def bd_metric_join(t):
    """Developers of latest plans with their customer count."""
    sp = R.plan_bd_spine(t).select("plan", "bd")
    cc = A.customers_per_manager(t["customer"])
    return sp.join(cc, sp["bd"] == cc["account_manager"], "left").select("plan", "bd", "customer_count")


@register("todo_open_count_join")
def todo_open_count_join(t):
    """Bucketed todos with their owner's open-todo count."""
    b = R.todo_buckets(t, TODO_AS_OF)
    c = A.open_todo_count(t["todo"], TODO_AS_OF)
    j = b.join(c, "owner", "left")
    return j.select("Todo_ID", "owner", F.coalesce(F.col("Count_Status_Open"), F.lit(0)).alias("Count_Status_Open"))


# -- aggregates -------------------------------------------------------------------


@register("collections_by_period")
def collections_by_period(t):
    """Collections of yesterday / this week / this month by manager."""
    return A.collections_by_manager(A.payment_party_totals(t["payment_entry"], AS_OF), t["customer"])


@register("daily_achievement_sums")
def daily_achievement_sums(t):
    """A2."""
    return A.daily_achievement_sums(t["daily_achievement"], AS_OF)


@register("weekly_achievement_sums")
def weekly_achievement_sums(t):
    """A3 (week)."""
    return A.weekly_achievement_sums(t["weekly_achievement"], AS_OF)


@register("monthly_achievement_sums")
def monthly_achievement_sums(t):
    """A3 (month)."""
    return A.monthly_achievement_sums(t["monthly_achievement"], AS_OF)


@register("zonal_targets")
def zonal_targets(t):
    """A4."""
    return A.zonal_targets(t["zonal"])


@register("customers_per_manager")
def customers_per_manager(t):
    """A5."""
    return A.customers_per_manager(t["customer"])


@register("outstanding_by_manager")
def outstanding_by_manager(t):
    """A6."""
    return A.outstanding_by_manager(t["sales_invoice"], t["customer"])


@register("ledger_balance")
def ledger_balance(t):
    """A7."""
    return A.ledger_balance(t["gl_entry"], t["journal_entry"], LEDGER_START)


@register("journal_adjustments")
def journal_adjustments(t):
    """A8."""
    return A.journal_adjustments(t["journal_entry"], t["journal_entry_account"], CONFIG.journal_voucher_types)


@register("unallocated_payments")
def unallocated_payments(t):
    """A9."""
    return A.unallocated_payments(A.payment_party_totals(t["payment_entry"], AS_OF))


@register("overdue_stage1")
def overdue_stage1(t):
    """A10: overdue per manager and balance pool."""
    r = R.receivable_inputs(t, CONFIG)
    s = M.receivable_pools_stage1(r["customer_sums"], r["ledger"], r["adjustments"], r["unallocated"])
    return s.select("account_manager", "total_unallocated_amount", "total_jv_amount", "total_gl_amount",
                    "overdue_amount", "net_overdue")


@register("overdue_by_manager")
def overdue_by_manager(t):
    """A11."""
    return R.manager_receivables(t, CONFIG).select("account_manager", "overdue_amount", "net_overdue")


@register("net_outstanding_by_manager")
def net_outstanding_by_manager(t):
    """A12."""
    return R.manager_receivables(t, CONFIG).select("account_manager", "net_outstanding_amount")


@register("customer_debt")
def customer_debt(t):
    """Per customer and credit limit, balances and ageing (all payment types)."""
    return R.customer_debt(t, CONFIG)


@register("open_leads_by_heat")
def open_leads_by_heat(t):
    """A14."""
    return A.open_leads_by_heat(t["lead"], t["opportunity"], t["customer"], CONFIG.product_line)


@register("opportunity_stage_pivot")
def opportunity_stage_pivot(t):
    """A15."""
    return A.opportunity_stage_pivot(t["lead"], t["opportunity"], t["customer"], CONFIG.product_line)


@register("customer_onboarding")
def customer_onboarding(t):
    """A16/F7."""
    return A.customer_onboarding(t["customer"], CONFIG.product_line, AS_OF)


@register("zero_order_counts")
def zero_order_counts(t):
    """Lead x opportunity x customer rows without orders, by manager."""
    zo = A.zero_order_customers(t["lead"], t["opportunity"], t["customer"], t["sales_order"], CONFIG.product_line,
                                AS_OF)
    return A.zero_order_counts(zo)


@register("zero_order_customers")
def zero_order_customers(t):
    """R6's customer list before one row per bd, with its opportunity multiplicity."""
    return A.zero_order_customers(t["lead"], t["opportunity"], t["customer"], t["sales_order"], CONFIG.product_line,
                                  AS_OF, excluded_contacts=CONFIG.excluded_contacts)


@register("open_todo_count")
def open_todo_count(t):
    """A18."""
    return A.open_todo_count(t["todo"], TODO_AS_OF)


@register("last_payment_date")
def last_payment_date(t):
    """A20."""
    return A.last_payment_date(t["payment_entry"])


@register("one_row_per_bd")
def one_row_per_bd(t):
    """One stated row per developer over all plans."""
    sp = R.with_team(R.plan_bd_spine(t, latest=False), R.teams(t["sales_person"]))
    return one_row_per_key(sp, ["bd"], [F.col("plan_date").desc_nulls_last(), F.col("plan").desc_nulls_last(),
                                        F.col("team_user_name").asc_nulls_first()]).select(
        "bd", "plan", "business_head", "zonal_head", "team_user_name", "custom_team")


@register("distinct_rows")
def distinct_rows(t):
    """Distinct customers on excluded receivable accounts."""
    return A.excluded_parties(t["party_account"], CONFIG.excluded_accounts)


def _achievement_days(t) -> DataFrame:
    return t["daily_achievement"].select(F.col("date").alias("day")).distinct()


@register("working_days_summary")
def working_days_summary(t):
    """The working-day calendar as of every achievement date."""
    d = F.col("day")
    return _achievement_days(t).select(
        "day", D.working_days_week(d).alias("working_days_week"), D.days_passed_week(d).alias("days_passed_week"),
        D.working_days_month(d).alias("working_days_month"), D.day_of_month(d).alias("day_of_month"))


@register("calendar_week")
def calendar_week(t):
    """The Monday..Sunday days of the week of every achievement date."""
    return _achievement_days(t).select(F.col("day").alias("as_of"), F.explode(D.week_days(F.col("day"))).alias("day"))


@register("calendar_month")
def calendar_month(t):
    """The days of the month of every achievement date."""
    return _achievement_days(t).select(F.col("day").alias("as_of"), F.explode(D.month_days(F.col("day"))).alias("day"))


# -- windows ----------------------------------------------------------------------


@register("latest_invoice_per_customer")
def latest_invoice_per_customer(t):
    """Latest invoice of each customer by posting date and time."""
    si = t["sales_invoice"].select("customer", "name", "posting_date", "posting_time")
    return pick_one(si, ["customer"], [F.col("posting_date").desc_nulls_last(), F.col("posting_time").desc_nulls_last(),
                                       F.col("name").desc_nulls_last()])


@register("invoice_rank_in_order")
def invoice_rank_in_order(t):
    """Row number of each invoice within its sales order; large orders (and the
    invoices without one) are ranked by day and time."""
    si = t["sales_invoice"].select("name", "sales_order", "posting_date", "posting_time")
    ranked = row_number_split(si, "sales_order", ["posting_date", "posting_time"], [F.col("name").desc_nulls_last()], hot_rows=1000)
    return ranked.select("name", "sales_order", "rn")


# -- sort and set operations --------------------------------------------------------


@register("category_custom_order")
def category_custom_order(t):
    """O3: dashboard rows with the FIELD() rank of their category."""
    d = R.report_dashboard(t, None, CONFIG, formatted=False)
    return d.select("custom_team", "bd_sales_person", "Category",
                    category_rank(F.col("Category"), DASHBOARD_CATEGORIES).alias("category_order"))


@register("category_union")
def category_union(t):
    """The three category branches as rows (numbers only)."""
    return R.report_dashboard(t, None, CONFIG, formatted=False)


# -- scalar functions ---------------------------------------------------------------


@register("day_offsets")
def day_offsets(t):
    """day arithmetic on every todo date."""
    d = F.col("date")
    return t["todo"].select("date").distinct().select(
        "date", D.day_offset(d, -1).alias("yesterday"), D.day_offset(d, 1).alias("tomorrow"),
        D.day_offset(d, -7).alias("week_ago"), D.months_back(d, 2).alias("two_months_back"))


def _invoice_terms(t) -> DataFrame:
    si = submitted(t["sales_invoice"]).select(F.col("name").alias("invoice_id"), "customer", "posting_date")
    c = t["customer"].select(F.col("name").alias("__c"), N.payment_terms_days("payment_terms").alias("payment_terms"))
    return si.join(c, F.col("customer") == F.col("__c")).drop("__c")


@register("invoice_due_flag")
def invoice_due_flag(t):
    """Due cut-off of every submitted invoice and whether it is overdue."""
    j = _invoice_terms(t)
    cut = N.due_cutoff(D.as_date(AS_OF), F.col("payment_terms"))
    return j.select("invoice_id", "posting_date", "payment_terms", cut.alias("due_cutoff"),
                    F.coalesce(F.col("posting_date") <= cut, F.lit(False)).alias("is_overdue"))


def _payment_days(t) -> DataFrame:
    return t["payment_entry"].select(F.to_date("creation").alias("day")).distinct()


@register("same_week_flag")
def same_week_flag(t):
    """payment days in the report date's Sunday week."""
    return _payment_days(t).select("day", D.same_week("day", AS_OF).alias("same_week"))


@register("same_month_flag")
def same_month_flag(t):
    """payment days in the report date's month."""
    return _payment_days(t).select("day", D.same_month("day", AS_OF).alias("same_month"))


@register("same_quarter_flag")
def same_quarter_flag(t):
    """payment days in the report date's quarter."""
    return _payment_days(t).select("day", D.same_quarter("day", AS_OF).alias("same_quarter"))


@register("calendar_parts")
def calendar_parts(t):
    """F8: calendar functions of every invoice posting date."""
    days = t["sales_invoice"].select(F.col("posting_date").alias("day")).distinct()
    return days.select("day", *[c.alias(n) for n, c in D.calendar_parts(F.col("day")).items()])


@register("achievement_last_7_days")
def achievement_last_7_days(t):
    """weekly achievements dated in the 7 days up to the report date."""
    wa = t["weekly_achievement"]
    return wa.where(D.last_days("date", AS_OF, 7)).select("bd", "date", "weekly_achievement")


@register("round_half_up")
def round_half_up(t):
    """invoice amounts in lakh and crore, rounded half-up."""
    si = t["sales_invoice"]
    return si.select("name", N.round_half_up(N.per_lakh("outstanding_amount"), 2).alias("lakh"),
                     N.round_half_up(N.per_crore("outstanding_amount"), 2).alias("crore"),
                     N.round_half_up(N.per_lakh("outstanding_amount"), 0).alias("lakh_0"))


@register("format_amount")
def format_amount(t):
    """invoice amounts as text with thousands separators."""
    si = t["sales_invoice"]
    return si.select("name", N.format_amount(N.times("outstanding_amount", 90)).alias("amount_text"))


@register("floor_at_zero")
def floor_at_zero(t):
    """journal adjustment of every customer floored at zero (NULL kept)."""
    c = t["customer"].select("name")
    jv = A.journal_adjustments(t["journal_entry"], t["journal_entry_account"], CONFIG.journal_voucher_types)
    j = c.join(jv, c["name"] == jv["party"], "left")
    return j.select("name", N.floor_at_zero(F.col("total_jv_amount") - F.lit(50000)).alias("floored"))


@register("coalesce_zero")
def coalesce_zero(t):
    """unallocated payments of every customer, 0 when none."""
    c = t["customer"].select("name")
    u = A.unallocated_payments(A.payment_party_totals(t["payment_entry"], AS_OF))
    j = c.join(u, c["name"] == u["party"], "left")
    return j.select("name", N.coalesce_zero("total_unallocated_amount").alias("total_unallocated_amount"))


@register("payment_terms_days")
def payment_terms_days(t):
    """payment terms text to days."""
    c = t["customer"]
    return c.select("name", "payment_terms", N.payment_terms_days("payment_terms").alias("payment_terms_days"))


@register("attainment_pct")
def attainment_pct(t):
    """Attainment percentages of the collection report."""
    return R.report_collection(t, None, CONFIG).select("team_username", "lwd_att", "week_att", "month_att")


# -- calendar and business metrics ----------------------------------------------------


@register("prorated_targets")
def prorated_targets(t):
    """D3: week- and month-to-date targets of every developer row."""
    bd = t["business_developer"]
    m = M.collection_targets(bd, AS_OF, CONFIG.unit_price)
    return bd.select("parent", "bd", m["wtd_tgt"].alias("wtd_tgt"), m["mtd_tgt"].alias("mtd_tgt"))


@register("target_scaling")
def target_scaling(t):
    """Targets in crore at the unit price."""
    bd = t["business_developer"]
    m = M.collection_targets(bd, AS_OF, CONFIG.unit_price)
    return bd.select("parent", "bd", m["lwd_tgt"].alias("lwd_tgt"), m["week_tgt"].alias("week_tgt"),
                     m["Month_TGT"].alias("Month_TGT"))


@register("ageing_buckets")
def ageing_buckets(t):
    """Overdue now / due tomorrow / due this week per customer and limit."""
    return R.customer_debt(t, CONFIG).select("customer_id", "credit_limit", "overdue_amount",
                                             "overdue_amount_tomorrow", "overdue_amount_this_week")


@register("net_outstanding")
def net_outstanding(t):
    """Net outstanding per customer (equals the ledger)."""
    return R.customer_debt(t, CONFIG).select("customer_id", "ledger", "net_outstanding").distinct()


@register("net_overdue")
def net_overdue(t):
    """Net overdue per customer, 0 when nothing is overdue."""
    d = R.customer_debt(t, CONFIG)
    return d.select("customer_id", M.zero_if_no_overdue(F.col("overdue_amount"), F.col("net_overdue2"))
                    .alias("net_overdue")).distinct()


@register("todo_label")
def todo_label(t):
    """Display label of every open recent todo (one per match combination)."""
    return R.todo_rows(t, TODO_AS_OF).select("name", M.todo_label().alias("label"))


@register("todo_day_buckets")
def todo_day_buckets(t):
    """The four day buckets of every open recent todo."""
    rows = R.todo_rows(t, TODO_AS_OF)
    b = M.day_buckets(F.col("date"), TODO_AS_OF, M.todo_label())
    return rows.select("name", *[c.alias(n) for n, c in b.items()])
