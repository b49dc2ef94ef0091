"""CRM tables derived from the driver's TPC-H-style parquet files.

Each view is one ``SELECT`` that runs unchanged in Spark SQL and DuckDB.
Driver tables are written as ``{name}`` placeholders: Spark binds them to
DataFrames through ``spark.sql(text, name=df)``; the DuckDB oracle formats them
back to bare view names.  The derived tables grow with the driver tables
(customers, orders, lineitem and events scale with sf).

Where a view keeps some rows of its driver table, the rows it keeps stand for a
kind of document: a priority or status becomes opportunities, orders or
payments, every fifth order key a journal, two in thirteen customers a booking
on another receivable account.  No view cuts rows for size.
"""

from __future__ import annotations

import string

from ..config import OPPORTUNITY_STAGES

VIEWS: dict[str, str] = {
    "sales_target": (
        "SELECT 'ST-'||r_regionkey||'-'||k AS name, 'bh'||r_regionkey AS business_head, "
        "'BH '||r_name AS sales_person, CAST(DATE '1998-01-01' + k*30 AS DATE) AS posting_date "
        "FROM {region} CROSS JOIN (VALUES (1),(2),(3)) t(k)"),
    "business_developer": (
        "SELECT 'ST-'||n_regionkey||'-'||k AS parent, 'bd'||s_suppkey AS bd, s_name AS bd_sales_person, "
        "'zh'||n_nationkey AS zonal_head, 'ZH '||n_name AS zonal_head_sales_person, "
        "CAST((s_suppkey % 7)*10000*k AS DECIMAL(21,9)) AS daily_targerts, "
        "CAST((s_suppkey % 7)*60000*k AS DECIMAL(21,9)) AS weekly_targets, "
        "CAST((s_suppkey % 7)*260000*k AS DECIMAL(21,9)) AS monthly_targets "
        "FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey CROSS JOIN (VALUES (1),(2),(3)) t(k)"),
    "sales_person": (
        "SELECT s_name AS name, 'bd'||s_suppkey AS custom_user, 'Team '||(s_nationkey % 4) AS custom_team "
        "FROM {supplier}"),
    "customer": (
        "SELECT 'C'||c_custkey AS name, c_name AS customer_name, "
        "'bd'||(c_custkey % (SELECT COUNT(*) FROM {supplier})) AS account_manager, "
        "CASE WHEN c_custkey % 5 <> 2 THEN 'Team '||(c_nationkey % 4) END AS custom_team, "
        "CASE WHEN c_custkey % 3 = 0 THEN 'L'||c_custkey END AS lead_name, "
        "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Net 30 days' WHEN 'MACHINERY' THEN '15 Days' "
        "WHEN 'BUILDING' THEN 'Advance' WHEN 'FURNITURE' THEN 'Net 45' END AS payment_terms, "
        "CASE WHEN c_custkey % 4 = 0 THEN 'Prepaid' ELSE 'Postpaid' END AS payment_type, "
        "CASE WHEN c_custkey % 10 = 9 THEN 'Lubricant' ELSE 'High Speed Diesel' END AS transaction_type, "
        "CASE WHEN c_custkey % 17 = 5 THEN 'OMC'||c_custkey END AS custom_omc_dealer_code, "
        "CASE WHEN c_custkey % 19 = 3 THEN NULL WHEN c_custkey % 19 = 4 THEN 'CON-ERP-FY-09064' "
        "ELSE 'CON'||c_custkey END AS customer_primary_contact, "
        "CAST(DATE '1997-01-01' + CAST(c_custkey % 500 AS INT) AS TIMESTAMP) AS creation "
        "FROM {customer}"),
    "lead": (
        "SELECT 'L'||c_custkey AS name, c_name AS company_name, "
        "'bd'||(c_custkey % (SELECT COUNT(*) FROM {supplier})) AS lead_owner, "
        "CASE WHEN c_custkey % 10 = 9 THEN 'Lubricant' ELSE 'High Speed Diesel' END AS transaction_type, "
        "CASE CAST(floor(c_custkey / 7) AS BIGINT) % 5 WHEN 0 THEN 'Hot' WHEN 1 THEN 'Warm' "
        "WHEN 2 THEN 'Cold' WHEN 3 THEN '' END AS hwc "
        "FROM {customer}"),
    # second-priority orders stand for opportunities
    "opportunity": (
        "SELECT 'OP'||o_orderkey AS name, 'L'||o_custkey AS party_name, 'Opp '||o_orderkey AS customer_name, "
        "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, (s, _) in enumerate(OPPORTUNITY_STAGES))
        + " END AS activity_ FROM {orders} WHERE o_orderpriority LIKE '2%'"),
    # finished first-priority orders stand for sales orders
    "sales_order": (
        "SELECT 'SO'||o_orderkey AS name, 'C'||o_custkey AS customer "
        "FROM {orders} WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'F'"),
    "sales_invoice": (
        "SELECT 'SI'||o_orderkey AS name, "
        "CASE WHEN o_custkey % 3 = 1 THEN NULL ELSE 'SO'||CAST(floor(o_orderkey / 3) AS BIGINT) END AS sales_order, "
        "'C'||o_custkey AS customer, CAST(o_orderdate AS DATE) AS posting_date, "
        "CAST(o_orderkey % 86400 AS BIGINT) AS posting_time, "
        "CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DECIMAL(18,2)) "
        "ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS outstanding_amount, "
        "CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Overdue' ELSE 'Cancelled' END AS status, "
        "CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END AS docstatus, "
        "'AD'||(o_custkey % 25) AS shipping_address_name "
        "FROM {orders}"),
    # finished orders stand for payments
    "payment_entry": (
        "SELECT 'PE'||o_orderkey AS name, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'C'||o_custkey END AS party, "
        "CAST(o_orderdate AS DATE) AS posting_date, CAST(o_orderdate AS TIMESTAMP) AS creation, "
        "CAST(o_totalprice * 50 AS DECIMAL(18,2)) AS paid_amount, "
        "CAST((o_orderkey % 5) * 1000 AS DECIMAL(18,2)) AS unallocated_amount, "
        "CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1 END AS docstatus, "
        "CASE WHEN o_orderkey % 6 = 0 THEN 'Draft' ELSE 'Submitted' END AS status "
        "FROM {orders} WHERE o_orderstatus = 'F'"),
    "gl_entry": (
        "SELECT 'GL'||o_orderkey AS name, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'C'||o_custkey END AS party, "
        "CASE WHEN o_orderkey % 31 = 0 THEN 'Supplier' ELSE 'Customer' END AS party_type, "
        "CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 'Sales' END AS against, "
        "'JE'||CAST(floor(o_orderkey / 2) AS BIGINT) * 2 AS voucher_no, CAST(o_orderdate AS TIMESTAMP) AS creation, "
        "CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS debit, "
        "CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS credit "
        "FROM {orders}"),
    # every fifth order key stands for a journal, with one or more lines
    "journal_entry": (
        "SELECT 'JE'||o_orderkey AS name, CASE o_orderkey % 3 WHEN 0 THEN 'Bank Entry' "
        "WHEN 1 THEN 'Journal Entry' ELSE 'Unlisted Entry' END AS voucher_type, "
        "CAST(CAST(floor(o_orderkey / 5) AS BIGINT) % 4 AS INT) AS docstatus "
        "FROM {orders} WHERE o_orderkey % 5 = 0"),
    "journal_entry_account": (
        "SELECT 'JE'||CAST(floor(o_orderkey / 5) AS BIGINT) * 5 AS parent, 'C'||o_custkey AS party, "
        "CASE WHEN o_orderkey % 4 = 0 THEN 'Supplier' ELSE 'Customer' END AS party_type, "
        "CASE WHEN o_orderkey % 7 = 0 THEN 'Sales Invoice' END AS reference_type, "
        "CAST(1 AS INT) AS docstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS credit, "
        "CAST(o_orderkey % 1000 AS DECIMAL(18,2)) AS debit "
        "FROM {orders} WHERE o_orderkey % 5 < 2"),
    # two in thirteen customers are booked on an account of their own
    "party_account": (
        "SELECT 'C'||c_custkey AS parent, CASE WHEN c_custkey % 2 = 0 "
        "THEN 'Trade Receivable for Inactive - TSL' ELSE 'Debtors - TSL' END AS account "
        "FROM {customer} WHERE c_custkey % 13 < 2"),
    "customer_credit_limit": (
        "SELECT 'C'||c_custkey AS parent, CAST(100000*k AS DECIMAL(18,2)) AS credit_limit, "
        "CAST(c_custkey % 2 AS INT) AS bypass_credit_limit_check "
        "FROM {customer} CROSS JOIN (VALUES (1),(2)) t(k) WHERE c_custkey % 11 <> 0 AND (k = 1 OR c_custkey % 40 = 7)"),
    "address": "SELECT 'AD'||n_nationkey AS name, n_name AS city FROM {nation}",
    "todo": (
        "SELECT 'TD'||event_id AS name, CASE WHEN event_id % 2 = 0 THEN 'BD' ELSE 'bd' END"
        "||(user_id % (SELECT COUNT(*) FROM {supplier})) AS owner, CAST(ts AS DATE) AS date, "
        "CASE WHEN event_type = 'error' THEN 'Closed' ELSE 'Open' END AS status, "
        "CASE event_id % 5 WHEN 0 THEN 'Customer' WHEN 1 THEN 'Lead' WHEN 2 THEN 'Opportunity' "
        "WHEN 3 THEN 'Event' ELSE 'Task' END AS reference_type, "
        "CASE event_id % 5 WHEN 0 THEN 'C'||user_id WHEN 1 THEN 'L'||user_id WHEN 2 THEN 'OP'||user_id "
        "WHEN 3 THEN 'EV'||event_id ELSE 'XX'||event_id END AS reference_name "
        "FROM {events}"),
    "event_participants": (
        "SELECT 'EV'||event_id AS parent, i AS idx, CASE event_id % 4 WHEN 0 THEN 'C'||user_id "
        "WHEN 1 THEN 'L'||user_id WHEN 2 THEN 'OP'||user_id ELSE 'ZZ'||user_id END AS reference_docname "
        "FROM {events} CROSS JOIN (VALUES (1),(2)) t(i) WHERE event_id % 5 = 3"),
    "daily_achievement": (
        "SELECT 'bd'||l_suppkey AS bd, 'ST-X' AS sales_target, CAST(l_shipdate AS DATE) AS date, "
        "CAST(25 AS DECIMAL(18,2)) AS daily_target, SUM(CASE WHEN l_suppkey % 10 = 1 THEN -1 ELSE 1 END * CAST(l_quantity AS DECIMAL(18,2))) AS daily_achievement, "
        "SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS daily_achievement_sales_order, "
        "SUM(CASE WHEN l_suppkey % 10 = 1 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2))) AS collection "
        "FROM {lineitem} "
        "GROUP BY l_suppkey, CAST(l_shipdate AS DATE)"),
    "weekly_achievement": (
        "SELECT 'bd'||l_suppkey AS bd, 'ST-X' AS sales_target, CAST(date_trunc('week', l_shipdate) AS DATE) + 2 AS date, "
        "CAST(150 AS DECIMAL(18,2)) AS weekly_target, SUM(CASE WHEN l_suppkey % 10 = 1 THEN -1 ELSE 1 END * CAST(l_quantity AS DECIMAL(18,2))) AS weekly_achievement, "
        "SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS daily_achievement_sales_order, "
        "SUM(CASE WHEN l_suppkey % 10 = 1 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2))) AS collection "
        "FROM {lineitem} "
        "GROUP BY l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) + 2"),
    "monthly_achievement": (
        "SELECT 'bd'||l_suppkey AS bd, 'ST-X' AS sales_target, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, "
        "CAST(650 AS DECIMAL(18,2)) AS monthly_target, SUM(CASE WHEN l_suppkey % 10 = 1 THEN -1 ELSE 1 END * CAST(l_quantity AS DECIMAL(18,2))) AS monthly_achievement, "
        "SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS daily_achievement_sales_order, "
        "SUM(CASE WHEN l_suppkey % 10 = 1 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2))) AS collection "
        "FROM {lineitem} "
        "GROUP BY l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE)"),
    "quaterly_achievement": (
        "SELECT 'bd'||l_suppkey AS bd, 'ST-X' AS sales_target, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, "
        "CAST(2000 AS DECIMAL(18,2)) AS quaterly_target, SUM(CASE WHEN l_suppkey % 10 = 1 THEN -1 ELSE 1 END * CAST(l_quantity AS DECIMAL(18,2))) AS quaterly_achievement, "
        "SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS quaterly_achievement_sales_order, "
        "SUM(CASE WHEN l_suppkey % 10 = 1 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2))) AS collection "
        "FROM {lineitem} "
        "GROUP BY l_suppkey, CAST(date_trunc('quarter', l_shipdate) AS DATE)"),
    "zonal": (
        "SELECT 'ST-'||n_regionkey||'-'||k AS parent, 'zh'||n_nationkey AS zonal_head, "
        "CAST(n_nationkey*1000 AS DECIMAL(18,2)) AS zones_target "
        "FROM {nation} CROSS JOIN (VALUES (1),(2),(3)) t(k)"),
}

# Parameter values the fixtures were built for.
FIXTURE_EXCLUDED_SALES_PERSON = "Supplier#000000003"


def driver_tables_of(view: str) -> list[str]:
    """Driver tables a view reads (its ``{placeholders}``)."""
    return sorted({f for _, f, _, _ in string.Formatter().parse(VIEWS[view]) if f})


def duckdb_view_sql(view: str) -> str:
    """The view text with bare driver table names, as DuckDB runs it."""
    names = driver_tables_of(view)
    return VIEWS[view].format(**{n: n for n in names})
