"""Reports and registered queries against their DuckDB oracles on sf0.001."""

import pytest

import __spark_entry__ as E
from salesops.config import DASHBOARD_CATEGORIES, REPORT_FIELDS
from salesops.operators.output import Field, columns_of, with_total_row
from salesops.plans import reports as R
from salesops.plans.catalog import QUERIES
from salesops.plans.compare import compare
from salesops.plans.oracles import ORACLES
from salesops.plans.params import CONFIG, TODO_CONFIG

from .conftest import SF_SMALL

REPORTS = ["report_funnel", "report_zero_order", "report_collection", "report_debtors", "report_dashboard",
           "report_appointment"]


@pytest.mark.parametrize("name", REPORTS)
def test_report_matches_oracle(spark, name):
    res = compare(E.queries()[name](spark, SF_SMALL), E.oracle_sql()[name], SF_SMALL)
    assert res["schema_match"] and res["value_match"], res


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) >= 95
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("report_total_row")))
def test_total_row_matches_oracle(spark, name):
    res = compare(E.queries()[name](spark, SF_SMALL), E.oracle_sql()[name], SF_SMALL)
    assert res["schema_match"] and res["value_match"], res


def test_total_row_keeps_equal_rows(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 1, 10.0), ("b", 2, None)], "team string, n int, pct double")
    fields = [Field("team", "Team"), Field("n", "N", "Int"), Field("pct", "P", "Percent")]
    got = sorted(map(tuple, with_total_row(df, fields).collect()), key=str)
    assert got == sorted([("a", 1, 10.0, False), ("a", 1, 10.0, False), ("b", 2, None, False), ("Total", 4, 20 / 3, True)], key=str)


@pytest.mark.parametrize("name", ["appointment", "dashboard", "funnel", "zero_order"])
def test_total_row_keeps_the_order(spark, fixtures, name):
    """With its total row a report has the same rows in the same order, and the total last."""
    config = TODO_CONFIG if name == "appointment" else CONFIG
    rows = R.report(name, fixtures, None, config, total=True).collect()
    assert [r["is_total"] for r in rows] == [False] * (len(rows) - 1) + [True]
    none_first = lambda v: (v is not None, v or "")
    rank = {c: i for i, c in enumerate(DASHBOARD_CATEGORIES)}
    key = {
        "appointment": lambda r: (none_first(r["Team"]), none_first(r["BD"])),
        "dashboard": lambda r: (*(none_first(r[c]) for c in ("custom_team", "zonal_head_sales_person", "bd_sales_person")), rank[r["Category"]]),
        "funnel": lambda r: (none_first(r["Team"]), none_first(r["Team_Username"])),
        "zero_order": lambda r: (r["days_since_last_onboarding"] is None, -(r["days_since_last_onboarding"] or 0)),
    }[name]
    keys = [key(r) for r in rows[:-1]]
    assert keys == sorted(keys) and len(set(keys)) > 2


def test_rows_come_in_report_order(spark, fixtures):
    none_first = lambda v: (v is not None, v or "")
    rows = R.report_appointment(fixtures, None, TODO_CONFIG).collect()
    keys = [(none_first(r["Team"]), none_first(r["BD"])) for r in rows]
    assert keys == sorted(keys) and len(set(keys)) > 3
    rows = R.report_funnel(fixtures, None, CONFIG).collect()
    keys = [(none_first(r["Team"]), none_first(r["Team_Username"])) for r in rows]
    assert keys == sorted(keys) and len(set(keys)) > 3
    rows = R.report_dashboard(fixtures, None, CONFIG).collect()
    rank = {c: i for i, c in enumerate(DASHBOARD_CATEGORIES)}
    keys = [(none_first(r["custom_team"]), none_first(r["zonal_head_sales_person"]), none_first(r["bd_sales_person"]), rank[r["Category"]]) for r in rows]
    assert keys == sorted(keys) and len(set(keys)) > 9
    days = [r["days_since_last_onboarding"] for r in R.report_zero_order(fixtures, None, CONFIG).collect()]
    shown = [d for d in days if d is not None]
    assert shown == sorted(shown, reverse=True) and days[: len(shown)] == shown and len(set(shown)) > 1


def test_config_switches(spark, fixtures):
    base = {r["team_username"]: r for r in R.report_collection(fixtures, None, CONFIG).collect()}
    fixed = {r["team_username"]: r for r in R.report_collection(fixtures, None, CONFIG.with_(fix_lwd_att=True)).collect()}
    for bd, r in base.items():
        if r["lwd_att"]:
            assert float(fixed[bd]["lwd_att"]) > float(r["lwd_att"])
    own = R.report_collection(fixtures, None, CONFIG.with_(per_customer_pools=True)).collect()
    assert sum(r["net_outstanding_amount"] or 0 for r in own) >= sum(r["net_outstanding_amount"] or 0 for r in base.values())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "net_outstanding_amount" in df.columns


def test_visibility_filters_rows(spark, fixtures):
    all_rows = R.report_funnel(fixtures, None, CONFIG).count()
    bh1 = R.report_funnel(fixtures, "bh1", CONFIG).count()
    nobody = R.report_funnel(fixtures, "no-such-user", CONFIG).count()
    assert 0 < bh1 < all_rows and nobody == 0


@pytest.mark.parametrize("name", list(R.REPORTS))
def test_report_columns_labelled(spark, fixtures, name):
    config = TODO_CONFIG if name == "appointment" else CONFIG
    for total in (False, True):
        cols = columns_of(R.report(name, fixtures, None, config, total=total))
        want = [dict(zip(("fieldname", "label", "fieldtype"), f)) for f in REPORT_FIELDS[name]]
        assert cols[: len(want)] == want
