"""Operators on hand-made rows: NULL rules, ties, and rewrites against the literal SQL form."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from salesops.operators import aggregates as A
from salesops.operators import metrics as M
from salesops.operators.joins import anti_join, disjunctive_left_join, not_in_subquery
from salesops.operators.star import Child, star_max
from salesops.operators.windows import latest_per_group, one_row_per_key


def _keys(df, col):
    return sorted((r[col] for r in df.collect()), key=lambda x: (x is None, x))


def test_not_in_subquery_sql_semantics(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    lst = spark.createDataFrame([("a",)], "v string")
    assert _keys(not_in_subquery(rows, "k", lst, "v"), "k") == ["b"]
    empty = spark.createDataFrame([], "v string")
    assert _keys(not_in_subquery(rows, "k", empty, "v"), "k") == ["a", "b", None]
    with_null = spark.createDataFrame([("a",), (None,)], "v string")
    assert not_in_subquery(rows, "k", with_null, "v").count() == 0
    # agrees with Spark SQL's own NOT IN
    rows.createOrReplaceTempView("nin_rows")
    for name, df in {"l1": lst, "l2": empty, "l3": with_null}.items():
        df.createOrReplaceTempView(name)
        sql = spark.sql(f"SELECT k FROM nin_rows WHERE k NOT IN (SELECT v FROM {name})")
        assert _keys(sql, "k") == _keys(not_in_subquery(rows, "k", df, "v"), "k")


def test_anti_join_keeps_null_keys(spark):
    left = spark.createDataFrame([("L1",), ("L2",), (None,)], "name string")
    right = spark.createDataFrame([("L1",), (None,)], "party_name string")
    assert _keys(anti_join(left, right, "name", "party_name"), "name") == ["L2", None]


def test_latest_per_group_ties_and_null_key(spark):
    st = spark.createDataFrame([
        ("P1", "bh1", dt.date(2024, 1, 1)), ("P2", "bh1", dt.date(2024, 1, 1)), ("P0", "bh1", dt.date(2023, 1, 1)),
        ("P3", None, dt.date(2024, 2, 1)), ("P4", None, None)], "name string, business_head string, posting_date date")
    got = {r.business_head: r.name for r in latest_per_group(st, ["business_head"], ["posting_date"]).collect()}
    assert got == {"bh1": "P2", None: "P3"}


def test_one_row_per_key_order(spark):
    df = spark.createDataFrame([("b1", 5, "C2"), ("b1", 9, "C9"), ("b1", 9, "C1"), ("b2", None, None)],
                               "bd string, days int, customer_id string")
    got = {r.bd: r.customer_id for r in one_row_per_key(
        df, ["bd"], [F.col("days").desc_nulls_last(), F.col("customer_id").asc_nulls_first()]).collect()}
    assert got == {"b1": "C1", "b2": None}


def test_disjunctive_join_equals_or_join(spark):
    rnd = random.Random(7)
    names = [f"K{i}" for i in range(12)] + [None]
    rows = [(f"T{i}", rnd.choice(names), rnd.choice(names)) for i in range(200)]
    targets = [(f"K{i}", f"label{i}") for i in range(0, 12, 2)] + [("K2", "dup")]
    r = spark.createDataFrame(rows, "id string, a string, b string")
    t = spark.createDataFrame(targets, "name string, label string")
    got = disjunctive_left_join(r, ["a", "b"], t, "name", ["name", "label"], "t_")
    r.createOrReplaceTempView("dj_rows")
    t.createOrReplaceTempView("dj_t")
    want = spark.sql("SELECT r.id, r.a, r.b, t.name AS t_name, t.label AS t_label FROM dj_rows r "
                     "LEFT JOIN dj_t t ON t.name = r.a OR t.name = r.b")
    cols = ["id", "a", "b", "t_name", "t_label"]
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, want.select(cols).collect()),
                                                                             key=str)


def test_star_max_equals_literal_product(spark):
    rnd = random.Random(11)
    as_of = dt.date(1998, 7, 15)
    bds = [f"bd{i}" for i in range(40)]

    def child(n):
        out = []
        for b in bds:
            for _ in range(rnd.randint(0, 3)):
                v = None if rnd.random() < 0.1 else Decimal(rnd.randint(-50, 100))
                out.append((b, as_of - dt.timedelta(days=rnd.randint(-3, 120)), v))
        return spark.createDataFrame(out, "bd string, date date, v decimal(10,2)")

    kids = {k: child(k) for k in "wdmq"}
    for k, df in kids.items():
        df.createOrReplaceTempView(f"star_{k}")
    keys = spark.createDataFrame([(b,) for b in bds], "bd string")
    keys.createOrReplaceTempView("star_keys")
    a = F.lit(as_of)
    preds = {
        "w": F.col("date").between(F.date_sub(a, 7), a),
        "d": F.col("date") == F.date_sub(a, 1),
        "m": (F.month("date") == 7) & (F.year("date") == 1998),
        "q": (F.quarter("date") == 3) & (F.year("date") == 1998),
    }
    conds = {**preds, "w": F.col("date").between(F.lit(dt.date(1998, 7, 12)), F.lit(dt.date(1998, 7, 18)))}
    children = [Child(k, kids[k], preds[k], conds[k], {"v": F.col("v")}) for k in "wdmq"]
    got = {r.bd: tuple(r[f"{k}_v"] for k in "wdmq") for r in star_max(keys, children).collect()}
    lit = spark.sql("""
        SELECT k.bd,
          MAX(CASE WHEN w.date BETWEEN DATE'1998-07-12' AND DATE'1998-07-18' THEN w.v ELSE 0 END) AS w_v,
          MAX(CASE WHEN d.date = DATE'1998-07-14' THEN d.v ELSE 0 END) AS d_v,
          MAX(CASE WHEN month(m.date) = 7 AND year(m.date) = 1998 THEN m.v ELSE 0 END) AS m_v,
          MAX(CASE WHEN quarter(q.date) = 3 AND year(q.date) = 1998 THEN q.v ELSE 0 END) AS q_v
        FROM star_keys k
        LEFT JOIN star_w w ON w.bd = k.bd LEFT JOIN star_d d ON d.bd = k.bd
        LEFT JOIN star_m m ON m.bd = k.bd LEFT JOIN star_q q ON q.bd = k.bd
        WHERE (w.date BETWEEN DATE'1998-07-08' AND DATE'1998-07-15') OR d.date = DATE'1998-07-14'
           OR (month(m.date) = 7 AND year(m.date) = 1998) OR (quarter(q.date) = 3 AND year(q.date) = 1998)
        GROUP BY k.bd""")
    want = {r.bd: tuple(r[f"{k}_v"] for k in "wdmq") for r in lit.collect()}
    assert got == want and len(want) > 5


def test_receivable_pools_pool_equal_balances(spark):
    sums = spark.createDataFrame([
        ("C1", "bd1", Decimal("100"), Decimal("80")),
        ("C2", "bd1", Decimal("50"), Decimal("40")),
        ("C3", "bd1", Decimal("70"), Decimal("0")),
    ], "customer_id string, account_manager string, outstanding_amount decimal(18,2), overdue_gross decimal(18,2)")
    ledger = spark.createDataFrame([("C1", Decimal("90")), ("C2", Decimal("90")), ("C3", Decimal("60"))],
                                   "party string, total_gl_amount decimal(18,2)")
    jv = spark.createDataFrame([("C1", Decimal("10")), ("C2", Decimal("10"))], "party string, total_jv_amount decimal(18,2)")
    pe = spark.createDataFrame([], "party string, total_unallocated_amount decimal(18,2)")
    pooled = M.receivable_pools(sums, ledger, jv, pe).first()
    # C1 and C2 share (ledger 90, jv 10, no unallocated): one pool, overdue 120 - 10 = 110 capped at 90
    assert float(pooled.overdue_amount) == 120.0
    assert float(pooled.net_overdue) == 90.0 + 0.0
    assert float(pooled.net_outstanding_amount) == 90.0 + 60.0
    per_customer = M.receivable_pools(sums, ledger, jv, pe, per_customer=True).first()
    assert float(per_customer.net_outstanding_amount) == 90.0 + 90.0 + 60.0
    assert float(per_customer.net_overdue) == 70.0 + 30.0 + 0.0


def test_journal_adjustments_filters(spark):
    je = spark.createDataFrame([("J1", "Bank Entry", 1), ("J2", "Unlisted", 1), ("J3", "Journal Entry", 0)],
                               "name string, voucher_type string, docstatus int")
    jea = spark.createDataFrame([
        ("J1", "C1", "Customer", None, 1, Decimal("100"), Decimal("30")),
        ("J1", "C1", "Customer", "Sales Invoice", 1, Decimal("999"), Decimal("0")),
        ("J1", "C2", "Supplier", None, 1, Decimal("5"), Decimal("0")),
        ("J2", "C1", "Customer", None, 1, Decimal("7"), Decimal("0")),
        ("J3", "C1", "Customer", None, 1, Decimal("8"), Decimal("0")),
    ], "parent string, party string, party_type string, reference_type string, docstatus int, "
       "credit decimal(18,2), debit decimal(18,2)")
    got = {r.party: float(r.total_jv_amount) for r in A.journal_adjustments(je, jea, ["Bank Entry", "Journal Entry"]).collect()}
    assert got == {"C1": 70.0}


def test_net_overdue_null_and_cap(spark):
    df = spark.createDataFrame([
        (None, Decimal("10"), None, Decimal("50")),
        (Decimal("100"), Decimal("10"), Decimal("5"), Decimal("50")),
        (Decimal("20"), Decimal("10"), Decimal("5"), Decimal("50")),
    ], "g decimal(18,2), jv decimal(18,2), pe decimal(18,2), gl decimal(18,2)")
    n = M.net_outstanding(F.col("gl"), F.lit(None), F.col("jv"), F.col("pe"))
    got = [r.x for r in df.select(M.net_overdue(F.col("g"), F.col("jv"), F.col("pe"), n).alias("x")).collect()]
    assert got[0] is None and float(got[1]) == 50.0 and float(got[2]) == 5.0


def test_manager_metrics_equals_separate_operators(spark, fixtures):
    from salesops.plans import reports as R
    from salesops.plans.params import CONFIG
    r = R.receivable_inputs(fixtures, CONFIG)

    def rows(df):
        cols = sorted(df.columns)
        return sorted((tuple(None if v is None else float(v) if not isinstance(v, str) else v for v in x)
                       for x in df.select(cols).collect()), key=str)

    for per_customer in (False, True):
        single = M.manager_metrics(r["party_totals"], r["customer_sums"], r["ledger"], r["adjustments"],
                                   fixtures["customer"], per_customer)
        coll = A.collections_by_manager(r["party_totals"], fixtures["customer"])
        pools = M.receivable_pools(r["customer_sums"], r["ledger"], r["adjustments"], r["unallocated"], per_customer)
        both = coll.join(pools, "account_manager", "full")
        keep = single.where(F.col("amount").isNotNull() | F.col("net_outstanding_amount").isNotNull())
        assert rows(keep) == rows(both)


def test_funnel_metrics_equals_separate_operators(spark, fixtures):
    from salesops.plans.params import CONFIG, AS_OF
    t, line = fixtures, CONFIG.product_line
    single = A.funnel_metrics(t["lead"], t["opportunity"], t["customer"], t["sales_order"], line)
    parts = [A.open_leads_by_heat(t["lead"], t["opportunity"], t["customer"], line),
             A.opportunity_stage_pivot(t["lead"], t["opportunity"], t["customer"], line),
             A.zero_order_counts(A.zero_order_customers(t["lead"], t["opportunity"], t["customer"],
                                                        t["sales_order"], line, AS_OF))]
    both = parts[0].join(parts[1], "bd", "full").join(parts[2], "bd", "full")
    # groups with nothing to count come out as all-NULL rows; left-joined to
    # the spine they are the same as no row
    measures = [c for c in single.columns if c != "bd"]
    single = single.where(" OR ".join(f"{c} IS NOT NULL" for c in measures))
    cols = sorted(single.columns)
    assert sorted(map(tuple, single.select(cols).collect()), key=str) == \
        sorted(map(tuple, both.select(cols).collect()), key=str)
