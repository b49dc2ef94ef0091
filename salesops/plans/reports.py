"""The six reports, composed from the operators.

Each report is ``report_x(tables, user=None, config=Config()) -> DataFrame``:
a lazy plan over the CRM tables; nothing runs until an action.  ``user``
filters rows the way the reports' visibility clause does (``None`` = all).

Shape shared by all of them: metrics are aggregated per business developer
(or per customer) first, then left-joined onto the *spine* of plans and
their developers, then reduced to one row per developer where the reports
rely on a loose ``GROUP BY bd``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DASHBOARD_CATEGORIES, OPPORTUNITY_STAGES, POSTPAID, REPORT_FIELDS, Config
from ..functions.dates import as_date, last_days, same_month, same_quarter, same_week
from ..functions.numeric import flag_yn, format_amount, payment_terms_days, per_lakh, times
from ..operators import aggregates as A
from ..operators.filters import open_recent_todos, visible_to
from ..operators.joins import ci_key, disjunctive_left_joins, left_join_split
from ..operators.metrics import (appointment_type, collection_targets, day_buckets, manager_metrics, net_outstanding,
                                 net_overdue, overdue_amount, receivable_pools, todo_label, zero_if_no_overdue)
from ..operators.output import Field, as_report, category_rank, unpivot_categories, with_total_row
from ..operators.star import Child, star_max
from ..operators.windows import latest_per_group, one_row_per_key, pick_one
from ..sources.loader import fold_users

DEFAULT = Config()


def cased(tables, config: Config):
    """The tables as the configuration compares user ids (``user`` is then given in lower case)."""
    return fold_users(tables) if config.ignore_case else tables


# -- spine ------------------------------------------------------------------

def latest_plans(sales_target: DataFrame) -> DataFrame:
    """Latest sales target per business head (ties: larger plan name)."""
    return latest_per_group(sales_target, ["business_head"], ["posting_date"])


def plan_bd_spine(tables, latest: bool = True) -> DataFrame:
    """Plans left-joined to their business developers (one row per plan x bd;
    a plan without developers keeps one row with NULL bd columns)."""
    st = tables["sales_target"]
    if latest:
        st = latest_plans(st)
    st = st.select(F.col("name").alias("plan"), "business_head", F.col("sales_person").alias("plan_sales_person"),
                   F.col("posting_date").alias("plan_date"))
    bd = tables["business_developer"]
    return st.join(bd, st["plan"] == bd["parent"], "left").drop("parent")


def teams(sales_person: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Sales persons as ``team_user_name, custom_user, custom_team``; names in
    ``exclude`` are removed first (so a later left join yields NULL)."""
    sp = sales_person
    if exclude:
        sp = sp.where(~F.col("name").isin(list(exclude)))
    return sp.select(F.col("name").alias("team_user_name"), "custom_user", "custom_team")


def with_team(df: DataFrame, team: DataFrame, on: str = "bd") -> DataFrame:
    return df.join(team, df[on] == team["custom_user"], "left").drop("custom_user")


def visible_spine(tables, user, exclude: tuple[str, ...] = ()) -> DataFrame:
    sp = visible_to(plan_bd_spine(tables), user)
    return with_team(sp, teams(tables["sales_person"], exclude))


SPINE_ORDER = ("business_head", "plan", "team_user_name", "custom_team")


def per_bd(df: DataFrame, *first) -> DataFrame:
    """One row per bd (loose ``GROUP BY bd.bd``) under a stated order."""
    order = list(first) + [F.col(c).asc_nulls_first() for c in SPINE_ORDER]
    return one_row_per_key(df, ["bd"], order)


# -- R5 funnel --------------------------------------------------------------

FUNNEL_COLUMNS = (["Team", "Team_Username", "BD", "zonal_head_sales_person", "zonal_head", "open_leads", "hot_leads",
                   "cold_leads", "warm_leads", "not_marked_leads", "opportunity_leads"]
                  + [c for _, c in OPPORTUNITY_STAGES]
                  + ["days_since_last_onboarding", "total_customers", "customers_0_orders"])


def report_funnel(tables, user=None, config: Config = DEFAULT) -> DataFrame:
    """Per bd: open leads by heat, opportunities by stage, onboarding recency,
    zero-order customers."""
    t, line, a = cased(tables, config), config.product_line, as_date(config.as_of)
    fm = A.funnel_metrics(t["lead"], t["opportunity"], t["customer"], t["sales_order"], line)
    co = A.customer_onboarding(t["customer"], line, a).drop("last_onboarding_date")
    j = visible_spine(t, user)
    for m in (fm, co):
        j = j.join(m, "bd", "left")
    j = per_bd(j)
    out = j.select(F.col("custom_team").alias("Team"), F.col("team_user_name").alias("Team_Username"),
                   F.col("bd_sales_person").alias("BD"), *FUNNEL_COLUMNS[3:])
    return out.distinct().orderBy(*order_of("funnel"))


# -- R6 zero order ----------------------------------------------------------

def report_zero_order(tables, user=None, config: Config = DEFAULT) -> DataFrame:
    """Per bd, one onboarded customer of the product line with opportunities and
    no sales order (the longest-onboarded one), primary contact not excluded."""
    t, a = cased(tables, config), as_date(config.as_of)
    zo = A.zero_order_customers(t["lead"], t["opportunity"], t["customer"], t["sales_order"],
                                config.product_line, a, excluded_contacts=config.excluded_contacts)
    zo = zo.select("bd", "customer_id", "customer_name", "payment_type", "days_since_last_onboarding")
    # pick the customer per bd before joining the spine: a bd with a huge
    # customer list is reduced map-side (partial WindowGroupLimit) and the
    # spine join becomes one-to-one
    first = [F.col("days_since_last_onboarding").desc_nulls_last(), F.col("customer_id").asc_nulls_first()]
    zo = pick_one(zo, ["bd"], first + [F.col("customer_name").asc_nulls_first(), F.col("payment_type").asc_nulls_first()])
    j = visible_spine(t, user).join(zo, "bd", "left")
    j = per_bd(j, *first)
    out = j.select(F.col("custom_team").alias("team"), F.col("team_user_name").alias("team_username"),
                   "zonal_head_sales_person", "zonal_head", "customer_id", "customer_name", "payment_type",
                   "days_since_last_onboarding")
    return out.distinct().orderBy(*order_of("zero_order"))


# -- receivables shared by R3 and R4 ------------------------------------------

def receivable_inputs(tables, config: Config) -> dict[str, DataFrame]:
    """Balances by party and invoice sums by eligible customer."""
    t, a = tables, as_date(config.as_of)
    pt = A.payment_party_totals(t["payment_entry"], config.as_of if config.as_of else a)
    cust = A.eligible_customers(t["customer"], t["party_account"], config.excluded_accounts)
    cust = cust.withColumn("payment_terms_days", payment_terms_days("payment_terms"))
    sums = A.customer_invoice_sums(t["sales_invoice"], cust, a,
                                   carry=("account_manager", "customer_name", "payment_type", "payment_terms_days"))
    return {
        "party_totals": pt,
        "eligible_customers": cust,
        "customer_sums": sums,
        "ledger": A.ledger_balance(t["gl_entry"], t["journal_entry"], config.ledger_start),
        "adjustments": A.journal_adjustments(t["journal_entry"], t["journal_entry_account"],
                                             config.journal_voucher_types),
        "unallocated": A.unallocated_payments(pt),
    }


# -- R3 collection ----------------------------------------------------------

COLLECTION_COLUMNS = ["bushead", "slp", "team", "head", "head_name", "team_username", "bd_name",
                      "net_outstanding_amount", "net_overdue_amount", "lwd_tgt", "lwd_actual", "lwd_att", "week_tgt",
                      "wtd_tgt", "Week_Actual", "week_att", "Month_TGT", "mtd_tgt", "MTD_Actual", "month_att"]


def manager_receivables(tables, config: Config, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Overdue, net overdue and net outstanding per account manager (pooled)."""
    r = inputs or receivable_inputs(tables, config)
    return receivable_pools(r["customer_sums"], r["ledger"], r["adjustments"], r["unallocated"],
                            config.per_customer_pools)


def report_collection(tables, user=None, config: Config = DEFAULT) -> DataFrame:
    """Per bd: net outstanding and overdue (lakh), and collections against the
    day / week-to-date / month-to-date targets (crore) with attainment."""
    t, a = cased(tables, config), as_date(config.as_of)
    r = receivable_inputs(t, config)
    mgr = manager_metrics(r["party_totals"], r["customer_sums"], r["ledger"], r["adjustments"], t["customer"],
                          config.per_customer_pools)
    j = visible_spine(t, user)
    j = j.join(mgr, j["bd"] == mgr["account_manager"], "left").drop("account_manager")
    j = per_bd(j)
    m = collection_targets(j, a, config.unit_price, config.fix_lwd_att)
    overdue = zero_if_no_overdue(F.col("overdue_amount"), F.col("net_overdue"), keep_overdue=True)
    out = j.select(
        F.col("business_head").alias("bushead"), F.col("plan_sales_person").alias("slp"),
        F.col("custom_team").alias("team"), F.col("zonal_head").alias("head"),
        F.col("zonal_head_sales_person").alias("head_name"), F.col("bd").alias("team_username"),
        F.col("bd_sales_person").alias("bd_name"),
        F.round(per_lakh(F.col("net_outstanding_amount")), 2).alias("net_outstanding_amount"),
        F.round(per_lakh(overdue), 2).alias("net_overdue_amount"),
        *[c.alias(n) for n, c in m.items()])
    return out.distinct()


# -- R4 debtors -------------------------------------------------------------

DEBTOR_COLUMNS = ["Team", "Team_Username", "zonal_head_sales_person", "zonal_head", "customer_id", "customer_name",
                  "customer_payment_type", "credit_limit", "payment_terms", "last_delivery_city",
                  "allowed_credit_breach", "ledger", "net_outstanding", "net_overdue", "overdue_amount_tomorrow",
                  "overdue_amount_this_week"]


def last_delivery_city(sales_invoice: DataFrame, address: DataFrame) -> DataFrame:
    """City of the shipping address of each customer's latest invoice."""
    latest = pick_one(sales_invoice.select("customer", "posting_date", "posting_time", "name", "shipping_address_name"),
                      ["customer"], [F.col("posting_date").desc_nulls_last(), F.col("posting_time").desc_nulls_last(),
                                     F.col("name").desc_nulls_last()])
    addr = address.select(F.col("name").alias("__addr"), "city")
    return latest.join(addr, F.col("shipping_address_name") == F.col("__addr"), "left").select(
        "customer", F.col("city").alias("last_delivery_city"))


def credit_limits(customer_credit_limit: DataFrame) -> DataFrame:
    """Distinct (customer, limit, breach flag) rows."""
    return customer_credit_limit.select(F.col("parent").alias("__ccl"), "credit_limit",
                                        flag_yn("bypass_credit_limit_check").alias("allowed_credit_breach")).distinct()


def customer_debt(tables, config: Config, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per eligible customer with a positive ledger, and per distinct credit
    limit: ledger, net outstanding, overdue and ageing buckets."""
    t = tables
    r = inputs or receivable_inputs(t, config)
    j = (r["customer_sums"].select(
        "customer_id", "customer_name", F.col("payment_type").alias("customer_payment_type"),
        F.col("account_manager").alias("bd"), F.col("payment_terms_days").alias("payment_terms"),
        "outstanding_amount", "overdue_gross", "due_tomorrow_gross", "due_week_gross")
         .join(r["ledger"].where(F.col("total_gl_amount") > 0), F.col("customer_id") == F.col("party")).drop("party")
         .join(r["adjustments"], F.col("customer_id") == F.col("party"), "left").drop("party")
         .join(r["unallocated"], F.col("customer_id") == F.col("party"), "left").drop("party"))
    ccl = credit_limits(t["customer_credit_limit"])
    j = j.join(ccl, F.col("customer_id") == F.col("__ccl"), "left").drop("__ccl")
    # the latest invoice of any state: a narrow branch of its own, reduced to one
    # row per customer before the shuffle (partial WindowGroupLimit)
    city = last_delivery_city(t["sales_invoice"], t["address"])
    j = j.join(city, F.col("customer_id") == F.col("customer"), "left").drop("customer")
    gl, jv, pe = F.col("total_gl_amount"), F.col("total_jv_amount"), F.col("total_unallocated_amount")
    n = net_outstanding(gl, F.col("outstanding_amount"), jv, pe)
    overdue = overdue_amount(F.col("overdue_gross"))
    return j.select(
        "customer_id", "customer_name", "customer_payment_type", "bd", "credit_limit", "payment_terms",
        "last_delivery_city", F.coalesce(F.col("allowed_credit_breach"), F.lit("N")).alias("allowed_credit_breach"),
        gl.alias("ledger"), jv.alias("adjustment"), pe.alias("unsettled_amount"), "outstanding_amount",
        n.alias("net_outstanding"),
        overdue.alias("overdue_amount"),
        overdue_amount(F.col("due_tomorrow_gross")).alias("overdue_amount_tomorrow"),
        overdue_amount(F.col("due_week_gross")).alias("overdue_amount_this_week"),
        net_overdue(F.col("overdue_gross"), jv, pe, n).alias("net_overdue2"))


def report_debtors(tables, user=None, config: Config = DEFAULT) -> DataFrame:
    """Per postpaid customer of a visible bd: ledger, net outstanding, net
    overdue, amounts falling due tomorrow and this week, credit terms."""
    t = cased(tables, config)
    debt = customer_debt(t, config).where(F.col("customer_payment_type") == POSTPAID)
    # teams go on the small spine first, so the debt is joined once and a bd with
    # a large share of the customers can be split
    j = visible_spine(t, user, config.excluded_sales_persons).join(debt, "bd")
    out = j.select(F.col("custom_team").alias("Team"), F.col("team_user_name").alias("Team_Username"),
                   "zonal_head_sales_person", "zonal_head", "customer_id", "customer_name", "customer_payment_type",
                   "credit_limit", "payment_terms", "last_delivery_city", "allowed_credit_breach", "ledger",
                   "net_outstanding",
                   zero_if_no_overdue(F.col("overdue_amount"), F.col("net_overdue2")).alias("net_overdue"),
                   "overdue_amount_tomorrow", "overdue_amount_this_week")
    return out.distinct()


# -- R2 dashboard -----------------------------------------------------------

DASHBOARD_MEASURES = ["LWD_Target", "LWD_Actual", "WTD_Target", "WTD_Actual", "MTD_Target", "MTD_Actual",
                      "QTD_Target", "QTD_Actual"]


def dashboard_children(tables, as_of, unit_price: int) -> list[Child]:
    t, a = tables, as_date(as_of)
    p = as_of if as_of is not None else a
    da, wa, ma, qa = (t["daily_achievement"], t["weekly_achievement"], t["monthly_achievement"],
                      t["quaterly_achievement"])
    yday = F.col("date") == F.date_sub(a, 1)
    sunday = F.date_sub(a, F.dayofweek(a) - 1)
    span = F.col("date").between

    def vals(target, orders, deliveries):
        return {"target": F.col(target), "target_price": times(target, unit_price), "Orders": F.col(orders),
                "Deliveries": F.col(deliveries), "Collection": F.col("collection")}

    return [
        Child("w", wa, last_days("date", a, 7), same_week("date", p),
              vals("weekly_target", "daily_achievement_sales_order", "weekly_achievement"),
              span(F.least(sunday, F.date_sub(a, 7)), F.date_add(sunday, 6))),
        Child("d", da, yday, yday, vals("daily_target", "daily_achievement_sales_order", "daily_achievement"), yday),
        Child("m", ma, same_month("date", p), same_month("date", p),
              vals("monthly_target", "daily_achievement_sales_order", "monthly_achievement"),
              span(F.trunc(a, "month"), F.last_day(a))),
        Child("q", qa, same_quarter("date", p), same_quarter("date", p),
              vals("quaterly_target", "quaterly_achievement_sales_order", "quaterly_achievement"),
              span(F.trunc(a, "quarter"), F.last_day(F.add_months(F.trunc(a, "quarter"), 2)))),
    ]


def dashboard_wide(tables, user=None, config: Config = DEFAULT) -> DataFrame:
    """One row per bd with all three categories' maxima side by side."""
    t = tables
    spine = visible_to(plan_bd_spine(t, latest=False), user)
    team = t["sales_person"].select(F.col("name").alias("__sp"), "custom_team")
    spine = spine.join(team, spine["bd_sales_person"] == team["__sp"], "left").drop("__sp")
    labels = one_row_per_key(spine.where(F.col("bd").isNotNull()), ["bd"],
                             [F.col("plan_date").desc_nulls_last(), F.col("plan").desc_nulls_last(),
                              F.col("custom_team").asc_nulls_first()]).select(
        "bd", "custom_team", "zonal_head_sales_person", "bd_sales_person")
    return star_max(labels, dashboard_children(t, config.as_of, config.unit_price))


def _dashboard_cell(category: str, measure: str) -> str:
    child = {"LWD": "d", "WTD": "w", "MTD": "m", "QTD": "q"}[measure[:3]]
    if measure.endswith("Target"):
        return f"{child}_target_price" if category == "Collection" else f"{child}_target"
    return f"{child}_{category}"


def report_dashboard(tables, user=None, config: Config = DEFAULT, formatted: bool = True) -> DataFrame:
    """Per bd x {Orders, Deliveries, Collection}: day / week / month / quarter
    target and actual.  Numbers come as decimals (``LWD_Target`` ...) and, with
    ``formatted``, also as text with thousands separators (``LWD_Target_text``)."""
    tables = cased(tables, config)
    wide = dashboard_wide(tables, user, config)
    long = unpivot_categories(wide, ["bd", "custom_team", "zonal_head_sales_person", "bd_sales_person"],
                              DASHBOARD_CATEGORIES, DASHBOARD_MEASURES, _dashboard_cell)
    cols = [F.col(c) for c in ["custom_team", "zonal_head_sales_person", "bd_sales_person", "Category"]]
    cols += [F.round(F.col(m), 2).alias(m) for m in DASHBOARD_MEASURES]
    if formatted:
        cols += [format_amount(F.col(m)).alias(f"{m}_text") for m in DASHBOARD_MEASURES]
    out = long.select(*cols)
    return out.orderBy(*order_of("dashboard"))


# -- R1 appointment ---------------------------------------------------------

APPOINTMENT_COLUMNS = ["Team", "BD", "Zonal_head", "Todo_ID", "Appointment_type", "Reference_Type", "Yesterday",
                       "Today", "Tomorrow", "Week", "Count_Status_Open"]


def todo_rows(tables, as_of, shown_days_only: bool = False) -> DataFrame:
    """Open recent todos with their first event participant and the customer /
    lead / opportunity their reference (or that participant) points to;
    ``shown_days_only`` keeps the days that can fall in a bucket."""
    t = tables
    td = open_recent_todos(t["todo"], as_of).select("name", "owner", "date", "reference_type", "reference_name")
    if shown_days_only:
        a = as_date(as_of)
        sunday = F.date_sub(a, F.dayofweek(a) - 1)
        td = td.where(F.col("date").between(F.least(sunday, F.date_sub(a, 1)),
                                            F.greatest(F.date_add(sunday, 6), F.date_add(a, 1))))
    ep = t["event_participants"].where(F.col("idx") == 1).select(
        F.col("parent").alias("ep_parent"), F.col("reference_docname").alias("ep_reference_docname"))
    rows = td.join(ep, td["reference_name"] == ep["ep_parent"], "left")
    return disjunctive_left_joins(rows, ["reference_name", "ep_reference_docname"], [
        (t["customer"], "name", ["name", "customer_name"], "tc_"),
        (t["lead"], "name", ["name", "company_name"], "tl_"),
        (t["opportunity"], "name", ["name", "customer_name"], "tpo_"),
    ])


def todo_buckets(tables, as_of) -> DataFrame:
    """Todos with a label in at least one of Yesterday / Today / Tomorrow / Week."""
    rows = todo_rows(tables, as_of, shown_days_only=True)
    b = day_buckets(F.col("date"), as_of, todo_label())
    out = rows.select(F.col("name").alias("Todo_ID"), "owner", "reference_type", "reference_name",
                      *[c.alias(n) for n, c in b.items()])
    return out.where(" OR ".join(f"{n} != '-'" for n in b))


def report_appointment(tables, user=None, config: Config = DEFAULT) -> DataFrame:
    """Per bd: its open todos in the day buckets, and its open-todo count."""
    t, as_of = cased(tables, config), config.as_of
    todos = todo_buckets(t, as_of)
    counts = A.open_todo_count(t["todo"], as_of)
    sp = visible_spine(t, user, config.excluded_sales_persons)
    # an owner may have a large share of the shown todos; the spine is small
    j = left_join_split(sp, todos, ci_key("bd"), ci_key("owner")).drop("owner")
    j = j.join(counts, j["bd"] == counts["owner"], "left")
    out = j.select(F.col("custom_team").alias("Team"), F.col("team_user_name").alias("BD"),
                   F.col("zonal_head_sales_person").alias("Zonal_head"), "Todo_ID",
                   appointment_type(F.col("reference_type")).alias("Appointment_type"),
                   F.col("reference_type").alias("Reference_Type"), "Yesterday", "Today", "Tomorrow", "Week",
                   F.coalesce(F.col("Count_Status_Open"), F.lit(0)).alias("Count_Status_Open"))
    return out.distinct().orderBy(*order_of("appointment"))


def order_of(name: str) -> list:
    """Sort of a report's rows; none for the collection and debtors reports."""
    first = lambda *names: [F.col(c).asc_nulls_first() for c in names]
    return {
        "appointment": first("Team", "BD"),
        "dashboard": [*first("custom_team", "zonal_head_sales_person", "bd_sales_person"),
                      category_rank(F.col("Category"), DASHBOARD_CATEGORIES)],
        "funnel": first("Team", "Team_Username"),
        "zero_order": [F.col("days_since_last_onboarding").desc_nulls_last()],
    }.get(name, [])


def fields_of(name: str) -> list[Field]:
    """Labelled columns of a report."""
    return [Field(*f) for f in REPORT_FIELDS[name]]


def with_totals(name: str, rows: DataFrame) -> DataFrame:
    """A report's rows in their order and its total row, last."""
    return with_total_row(rows, fields_of(name), order=order_of(name))


def report(name: str, tables, user=None, config: Config = DEFAULT, total: bool = False) -> DataFrame:
    """A report by name with its labelled columns first (``columns_of`` lists
    them), unlisted ones behind; ``total`` appends the total row."""
    rows = REPORTS[name](tables, user, config)
    return as_report(with_totals(name, rows) if total else rows, fields_of(name))


REPORTS = {
    "appointment": report_appointment,
    "collection": report_collection,
    "dashboard": report_dashboard,
    "debtors": report_debtors,
    "funnel": report_funnel,
    "zero_order": report_zero_order,
}
