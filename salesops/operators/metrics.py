"""Business measures: targets, attainment, receivable balances, ageing, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import (DateLike, as_date, day_of_month, days_passed_week, same_week,
                               working_days_month, working_days_week)
from ..functions.numeric import (case_least, floor_at_zero, per_crore, per_lakh, safe_divide, times)


# -- receivables ------------------------------------------------------------

def net_outstanding(gl: Column, outstanding: Column, jv: Column, unallocated: Column) -> Column:
    """``CASE WHEN gl != X THEN gl ELSE X END`` with
    ``X = IFNULL(IFNULL(outstanding, 0) - COALESCE(jv, 0) - IFNULL(unallocated, 0), 0)``.
    For a non-NULL ledger this is always the ledger."""
    x = F.coalesce(F.coalesce(outstanding, F.lit(0)) - F.coalesce(jv, F.lit(0)) - F.coalesce(unallocated, F.lit(0)),
                   F.lit(0))
    return F.when(gl != x, gl).otherwise(x)


def overdue_amount(overdue_gross: Column) -> Column:
    """``ROUND(GREATEST(overdue, 0), 2)`` keeping NULL."""
    return F.round(floor_at_zero(overdue_gross), 2)


def net_overdue(overdue_gross: Column, jv: Column, unallocated: Column, net_out: Column) -> Column:
    """Overdue less unallocated payments and journal adjustments, floored at
    0, rounded, and capped at the net outstanding (``CASE WHEN r > n THEN n ELSE r``)."""
    r = F.round(floor_at_zero(overdue_gross - F.coalesce(unallocated, F.lit(0)) - F.coalesce(jv, F.lit(0))), 2)
    return case_least(r, net_out)


def zero_if_no_overdue(overdue: Column, value: Column, keep_overdue: bool = False) -> Column:
    """``CASE WHEN overdue = 0 THEN 0 (or overdue) ELSE value END``."""
    return F.when(overdue == 0, overdue if keep_overdue else F.lit(0)).otherwise(value)


def receivable_pools_stage1(customer_sums: DataFrame, ledger: DataFrame, adjustments: DataFrame,
                            unallocated: DataFrame, per_customer: bool = False) -> DataFrame:
    """Overdue, net overdue and net outstanding per pool.

    Customers with a positive ledger are grouped by manager **and** their three
    balances (ledger, journal, unallocated), as the collection report does:
    customers of one manager with equal balances form one pool whose ledger
    and adjustments count once.  ``per_customer=True`` groups by customer
    instead.  ``customer_sums`` carries customer_id, account_manager,
    outstanding_amount and overdue_gross (already one row per customer, so
    every join below is one-to-one on the party key).
    """
    j = (customer_sums
         .join(ledger.where(F.col("total_gl_amount") > 0), F.col("customer_id") == ledger["party"])
         .drop("party")
         .join(adjustments, F.col("customer_id") == adjustments["party"], "left").drop("party")
         .join(unallocated, F.col("customer_id") == unallocated["party"], "left").drop("party"))
    keys = ["account_manager", "total_unallocated_amount", "total_jv_amount", "total_gl_amount"]
    if per_customer:
        keys.append("customer_id")
    pools = j.groupBy(*keys).agg(F.sum("overdue_gross").alias("overdue_gross"),
                                 F.sum("outstanding_amount").alias("outstanding_amount"))
    gl, jv, pe = F.col("total_gl_amount"), F.col("total_jv_amount"), F.col("total_unallocated_amount")
    n = net_outstanding(gl, F.col("outstanding_amount"), jv, pe)
    return pools.select(*keys,
                        overdue_amount(F.col("overdue_gross")).alias("overdue_amount"),
                        net_overdue(F.col("overdue_gross"), jv, pe, n).alias("net_overdue"),
                        n.alias("net_outstanding"))


def receivable_pools(customer_sums: DataFrame, ledger: DataFrame, adjustments: DataFrame,
                     unallocated: DataFrame, per_customer: bool = False) -> DataFrame:
    """Overdue, net overdue and net outstanding summed per account manager."""
    pools = receivable_pools_stage1(customer_sums, ledger, adjustments, unallocated, per_customer)
    return pools.groupBy("account_manager").agg(
        F.sum("overdue_amount").alias("overdue_amount"),
        F.sum("net_overdue").alias("net_overdue"),
        F.sum("net_outstanding").alias("net_outstanding_amount"),
    )


# -- targets and attainment -------------------------------------------------

def crore_target(target: Column, unit_price: int) -> Column:
    """``ROUND(target * price / 10000000, 2)``."""
    return F.round(per_crore(times(target, unit_price)), 2)


def prorated_target(target: Column, unit_price: int, working_days: Column, days_passed: Column) -> Column:
    """``ROUND(target * price / (10000000 * working_days) * days_passed, 2)``."""
    return F.round(safe_divide(times(target, unit_price), F.lit(10000000) * working_days) * days_passed, 2)


def attainment_pct(actual_rounded: Column, gate_target: Column, divisor: Column) -> Column:
    """``ROUND(CASE WHEN COALESCE(gate, 0) = 0 THEN 0 ELSE COALESCE(actual, 0) / divisor * 100 END, 0)``;
    a zero divisor gives NULL."""
    pct = safe_divide(F.coalesce(actual_rounded, F.lit(0)), divisor) * 100
    return F.round(F.when(F.coalesce(gate_target, F.lit(0)) == 0, F.lit(0)).otherwise(pct), 0)


def collection_targets(df: DataFrame, as_of: DateLike, unit_price: int, fix_lwd_att: bool = False) -> dict[str, Column]:
    """Day / week / month target, actual and attainment columns of the collection
    report, from ``daily_targerts``, ``weekly_targets``, ``monthly_targets``
    and the collections ``amount``, ``week_collection``, ``month_collection``."""
    a = as_date(as_of)
    wdw, dpw = working_days_week(a), days_passed_week(a)
    wdm, dom = working_days_month(a), day_of_month(a)
    daily, weekly, monthly = F.col("daily_targerts"), F.col("weekly_targets"), F.col("monthly_targets")
    lwd_actual = F.round(per_crore(F.col("amount")), 2)
    week_actual = F.round(per_crore(F.col("week_collection")), 2)
    mtd_actual = F.round(per_crore(F.col("month_collection")), 2)
    daily_cr = F.round(per_crore(times(daily, unit_price)), 2)
    daily_div = daily_cr if fix_lwd_att else F.coalesce(F.round(per_lakh(times(daily, unit_price)), 2), F.lit(0))
    week_tgt = crore_target(weekly, unit_price)
    wtd_tgt = prorated_target(weekly, unit_price, wdw, dpw)
    month_tgt = crore_target(monthly, unit_price)
    mtd_tgt = prorated_target(monthly, unit_price, wdm, dom)
    return {
        "lwd_tgt": F.round(F.when(daily == 0, F.lit(0)).otherwise(per_crore(times(daily, unit_price))), 2),
        "lwd_actual": lwd_actual,
        "lwd_att": attainment_pct(lwd_actual, daily_cr, daily_div),
        "week_tgt": week_tgt,
        "wtd_tgt": wtd_tgt,
        "Week_Actual": week_actual,
        "week_att": attainment_pct(week_actual, week_tgt, wtd_tgt),
        "Month_TGT": month_tgt,
        "mtd_tgt": mtd_tgt,
        "MTD_Actual": mtd_actual,
        "month_att": attainment_pct(mtd_actual, month_tgt, mtd_tgt),
    }


# -- appointments -----------------------------------------------------------

def todo_label() -> Column:
    """Display label of a todo's reference: the customer / lead / opportunity
    name it points to, else through its first event participant, else the raw
    reference.  Expects columns reference_name, ep_parent, ep_reference_docname,
    tc_name, tc_customer_name, tl_name, tl_company_name, tpo_name, tpo_customer_name."""
    ref, doc = F.col("reference_name"), F.col("ep_reference_docname")
    tc, tl, tpo = F.col("tc_name"), F.col("tl_name"), F.col("tpo_name")
    via_event = (F.when(doc == tc, F.col("tc_customer_name"))
                 .when(doc == tl, F.col("tl_company_name"))
                 .when(doc == tpo, F.col("tpo_customer_name"))
                 .otherwise(doc))
    return (F.when(ref == tc, F.col("tc_customer_name"))
            .when(ref == tl, F.col("tl_company_name"))
            .when(ref == tpo, F.col("tpo_customer_name"))
            .when(ref == F.col("ep_parent"), via_event)
            .otherwise(ref))


def day_buckets(date_col: Column, as_of: DateLike, label: Column, empty: str = "-") -> dict[str, Column]:
    """The label in the Yesterday / Today / Tomorrow / Week column the todo
    falls in, ``'-'`` elsewhere."""
    a = as_date(as_of)
    e = F.lit(empty)
    return {
        "Yesterday": F.when(date_col == F.date_sub(a, 1), label).otherwise(e),
        "Today": F.when(date_col == a, label).otherwise(e),
        "Tomorrow": F.when(date_col == F.date_add(a, 1), label).otherwise(e),
        "Week": F.when(same_week(date_col, as_of), label).otherwise(e),
    }


def appointment_type(reference_type: Column) -> Column:
    return F.when(reference_type == "Event", F.lit("Event")).otherwise(F.lit("Task"))


def team_or_others(team: Column) -> Column:
    return F.when(team.isNull(), F.lit("Others")).otherwise(team)


def open_posting_date(status: Column, posting_date: Column, closed: Sequence[str] = ("Cancelled", "Paid")) -> Column:
    """Posting date of invoices that are not cancelled or paid (NULL otherwise)."""
    return F.when(~status.isin(list(closed)), posting_date)


def manager_metrics(party_totals: DataFrame, customer_sums: DataFrame, ledger: DataFrame, adjustments: DataFrame,
                    customer: DataFrame, per_customer: bool = False) -> DataFrame:
    """Collections and pooled receivables per account manager in one pass.

    The collection report needs, per manager, (a) collections of payers and
    (b) the pooled overdue / net outstanding of eligible customers.  Both come
    from party-keyed aggregates, so they are full-outer-joined on the party
    (all inputs are already one row per party and hash-partitioned on it) and
    reduced by one aggregation over ``GROUPING SETS ((manager), (manager,
    unallocated, journal, ledger))``: the first set sums collections of rows
    with a submitted payment, the second forms the pools of eligible
    customers with a positive ledger.  A last aggregation per manager
    combines them.  Every input, payments included, is read once.

    Same result as ``collections_by_manager`` + ``receivable_pools``.
    """
    pt = party_totals
    es = customer_sums.select(F.col("customer_id").alias("__e"), F.col("account_manager").alias("__em"),
                              "outstanding_amount", "overdue_gross")
    u = pt.join(es, pt["party"] == es["__e"], "full")
    u = u.select(F.coalesce(F.col("party"), F.col("__e")).alias("__p"), "__e", "__em", "n_collections",
                 "yesterday_collection", "week_collection", "month_collection", "total_unallocated_amount",
                 "outstanding_amount", "overdue_gross")
    c = customer.select(F.col("name").alias("__c"), F.col("account_manager").alias("__cm"))
    u = (u.join(c, F.col("__p") == F.col("__c"), "left")
          .join(ledger, F.col("__p") == ledger["party"], "left").drop("party")
          .join(adjustments, F.col("__p") == adjustments["party"], "left").drop("party"))
    u = u.withColumn("account_manager", F.coalesce(F.col("__em"), F.col("__cm")))
    payer = F.col("n_collections") > 0
    member = F.col("__e").isNotNull() & (F.col("total_gl_amount") > 0)
    pool_keys = ["account_manager", "total_unallocated_amount", "total_jv_amount", "total_gl_amount"]
    if per_customer:
        pool_keys.append("__e")
    g = u.groupingSets([["account_manager"], pool_keys], *pool_keys).agg(
        F.grouping_id().alias("__gid"),
        F.sum(F.when(payer, F.col("yesterday_collection"))).alias("amount"),
        F.sum(F.when(payer, F.col("week_collection"))).alias("week_collection"),
        F.sum(F.when(payer, F.col("month_collection"))).alias("month_collection"),
        F.count_if(member).alias("__members"),
        F.sum(F.when(member, F.col("overdue_gross"))).alias("__over"),
        F.sum(F.when(member, F.col("outstanding_amount"))).alias("__out"))
    is_pool = (F.col("__gid") == 0) & (F.col("__members") > 0)
    is_coll = F.col("__gid") != 0
    gl, jv, pe = F.col("total_gl_amount"), F.col("total_jv_amount"), F.col("total_unallocated_amount")
    n = net_outstanding(gl, F.col("__out"), jv, pe)
    return g.groupBy("account_manager").agg(
        F.sum(F.when(is_coll, F.col("amount"))).alias("amount"),
        F.sum(F.when(is_coll, F.col("week_collection"))).alias("week_collection"),
        F.sum(F.when(is_coll, F.col("month_collection"))).alias("month_collection"),
        F.sum(F.when(is_pool, overdue_amount(F.col("__over")))).alias("overdue_amount"),
        F.sum(F.when(is_pool, net_overdue(F.col("__over"), jv, pe, n))).alias("net_overdue"),
        F.sum(F.when(is_pool, n)).alias("net_outstanding_amount"))
