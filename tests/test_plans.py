"""Plan shape: no nested-loop or cartesian joins; one scan of each large fact table."""

import re

import pytest

from salesops.plans import reports as R
from salesops.plans.params import CONFIG, TODO_CONFIG

BUILDERS = {
    "funnel": lambda t: R.report_funnel(t, None, CONFIG),
    "zero_order": lambda t: R.report_zero_order(t, None, CONFIG),
    "collection": lambda t: R.report_collection(t, None, CONFIG),
    "debtors": lambda t: R.report_debtors(t, None, CONFIG),
    "dashboard": lambda t: R.report_dashboard(t, None, CONFIG),
    "appointment": lambda t: R.report_appointment(t, None, TODO_CONFIG),
}


def _final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(BUILDERS))
def test_no_nested_loop_or_cartesian(spark, stored, name):
    plan = _final_plan(BUILDERS[name](stored))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_collection_scan_counts(spark, stored):
    """The collection report reads each fact table once (the SQL reads the
    ledger twice and payments four times): collections and pooled
    receivables share one pass (``metrics.manager_metrics``)."""
    df = R.report_collection(stored, None, CONFIG)
    plan = _final_plan(df)
    for table in ("gl_entry", "payment_entry", "sales_invoice", "journal_entry_account"):
        scans = re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", plan)
        assert len(scans) == 1, (table, len(scans))


def test_filters_reach_the_scan(spark, stored):
    t = stored
    from salesops.operators.aggregates import ledger_balance
    plan = ledger_balance(t["gl_entry"], t["journal_entry"], CONFIG.ledger_start)._jdf.queryExecution() \
        .executedPlan().toString()
    gl_scan = [l for l in plan.splitlines() if "gl_entry.parquet" in l][0]
    assert "GreaterThanOrEqual(creation,1996-04-01" in gl_scan
    # only the seven columns used are read; the GL name is not
    assert "FileScan parquet [party#" in gl_scan and "name#" not in gl_scan.split("]")[0]
    je_scan = [l for l in plan.splitlines() if "journal_entry.parquet" in l][0]
    assert "Not(EqualTo(docstatus,1))" in je_scan


def test_debtor_plan(spark, stored):
    """Balances read each fact table once, invoices twice (sums; latest invoice
    per customer); no sort-based aggregation of invoices."""
    plan = _final_plan(R.report_debtors(stored, None, CONFIG))
    for table, want in (("gl_entry", 1), ("payment_entry", 1), ("sales_invoice", 2), ("journal_entry_account", 1),
                        # the list, and the look for a NULL, shown at the filter and again at the scan it is pushed to
                        ("party_account", 3)):
        scans = re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", plan)
        assert len(scans) <= want, (table, len(scans))
    assert "SortAggregate" not in plan


@pytest.fixture
def long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "3000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_appointment_reads_the_shown_days(spark, stored, long_plans):
    """The day range reaches every todo scan but the one that counts open todos."""
    plan = _final_plan(R.report_appointment(stored, None, TODO_CONFIG))
    scans = [x for x in plan.splitlines() if "/todo.parquet" in x]
    shown = [x for x in scans if "GreaterThanOrEqual(date,2024-01-14)" in x and "LessThanOrEqual(date,2024-01-20)" in x]
    assert len(shown) == len(scans) - 1 and "collect_list" not in plan


def test_dashboard_pushes_date_spans(spark, stored, long_plans):
    plan = R.report_dashboard(stored, None, CONFIG)._jdf.queryExecution().executedPlan().toString()
    for table, low in (("daily", "EqualTo(date,1998-07-14)"), ("weekly", "GreaterThanOrEqual(date,1998-07-08)"),
                       ("monthly", "GreaterThanOrEqual(date,1998-07-01)"), ("quaterly", "GreaterThanOrEqual(date,1998-07-01)")):
        scans = [x for x in plan.splitlines() if f"/{table}_achievement.parquet" in x]
        assert any(low in x for x in scans), (table, scans)
        # the other scan of the table reads the key and the date only
        assert all(low in x or "collection" not in x for x in scans)


def test_ledger_has_one_exchange(spark, stored):
    from salesops.operators.aggregates import ledger_balance
    df = ledger_balance(stored["gl_entry"], stored["journal_entry"], CONFIG.ledger_start)
    plan = _final_plan(df)
    final = plan.split("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(party", final)) == 1


def test_funnel_has_no_distinct_aggregate(spark, stored):
    plan = R.report_funnel(stored, None, CONFIG)._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan


def test_funnel_scan_counts(spark, stored):
    """The funnel reads leads, opportunities and sales orders once and
    customers twice (the SQL reads leads 3x, opportunities 3x, customers 4x):
    lead-owner and manager measures are two grouping sets of one aggregation."""
    plan = _final_plan(R.report_funnel(stored, None, CONFIG))
    for table, want in (("lead", 1), ("opportunity", 1), ("sales_order", 1), ("customer", 2)):
        scans = re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", plan)
        assert len(scans) == want, (table, len(scans))


def _executed_plan(df) -> str:
    """The plan as it ran, with reused exchanges."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def _scans(plan: str, table: str) -> list[str]:
    return re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", plan)


def _rows_read(df, table: str) -> list[int]:
    """Rows each scan of a table gave, from the executed plan's metrics."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif "QueryStageExec" in name:
            todo.append(node.plan())
        elif name == "FileSourceScanExec" and f"/{table}." in node.toString():
            found.append(int(node.metrics().apply("numOutputRows").value()))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_or_join_scan_counts(spark, stored, long_plans):
    """Todos: the key tuples, the rows, and in the report the open counts."""
    plan = _executed_plan(R.report_appointment(stored, None, TODO_CONFIG))
    assert len(_scans(plan, "todo")) <= 3 and len(_scans(plan, "event_participants")) <= 2
    plan = _executed_plan(R.todo_rows(stored, TODO_CONFIG.as_of))
    assert len(_scans(plan, "todo")) <= 2 and len(_scans(plan, "event_participants")) <= 2


def test_not_in_reads_its_input_once(spark, stored, long_plans):
    from salesops.operators.aggregates import excluded_parties
    from salesops.operators.joins import not_in_subquery
    si = stored["sales_invoice"].select("customer", "name")
    out = not_in_subquery(si, "customer", excluded_parties(stored["party_account"], CONFIG.excluded_accounts), "customer_code")
    assert _rows_read(out, "sales_invoice") == [stored["sales_invoice"].count()]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_periods_of_today_reach_the_scan(spark, stored, long_plans):
    """Without a report date the current date is folded into the period's bounds."""
    from salesops.config import Config
    from salesops.functions.dates import same_period
    assert Config().as_of is None
    for unit in ("week", "month", "quarter"):
        plan = stored["daily_achievement"].where(same_period("date", Config().as_of, unit))._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedFilters: \[[^\n]*GreaterThanOrEqual\(date,\d{4}-\d\d-\d\d\)[^\n]*LessThanOrEqual\(date,\d{4}", plan), plan


def _star_files(spark, path, outside):
    from salesops.operators.star import Child, star_max
    days = spark.range(2000).selectExpr("concat('bd', id % 50) bd", "date'2024-01-01' + cast(id % 400 as int) date", "cast(id % 90 as decimal(9,2)) v")
    days.unionByName(spark.createDataFrame(outside, days.schema)).coalesce(1).write.mode("overwrite").parquet(f"{path}/days.parquet")
    from pyspark.sql import functions as F
    inside = F.col("date") == F.lit("2024-01-20").cast("date")
    df = spark.read.parquet(f"{path}/days.parquet")
    keys = df.select("bd").distinct()
    hits = keys.select("bd", F.lit(1).alias("w"))
    return star_max(keys.select("bd"), [Child("d", df, inside, inside, {"v": F.col("v")}, inside), Child("e", hits, F.lit(True), F.lit(True), {"w": F.col("w")})])


def test_star_looks_outside_for_needy_keys_only(spark, tmp_path, long_plans):
    """Whether a key has another row is read only where its maximum inside is negative or NULL."""
    import datetime as dt
    from decimal import Decimal as D
    none = _star_files(spark, tmp_path / "none", [])
    # One key has the day, its maximum is not below 0: the look outside is dropped at run time.
    rows = {r["bd"]: r["d_v"] for r in none.collect()}
    assert len(rows) == 50 and rows["bd19"] > 0 and "__star_c" not in none._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    day = dt.date(2024, 1, 20)
    some = _star_files(spark, tmp_path / "some", [("only", day, D("-3.00")), ("zz", day, D("-4.00")), ("zz", dt.date(2023, 1, 1), D("9.00")), ("zn", day, None)])
    got = {r["bd"]: r["d_v"] for r in some.collect()}
    assert got["only"] == -3 and got["zz"] == 0 and got["zn"] is None and got["bd19"] == rows["bd19"]
    assert "LeftSemi" in some._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
