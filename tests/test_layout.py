"""Bucketed and sorted fact tables: same rows, no exchange by party, skipped row groups."""

import re

import pytest

from salesops.operators import aggregates as A
from salesops.plans import reports as R
from salesops.plans.params import CONFIG
from salesops.sources.layout import LAYOUTS, read_layout, table_name, write_layout

from .test_plans import _rows_read

BUCKETS = 4


@pytest.fixture(scope="module")
def laid_out(spark, fixtures, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("laid"))
    write_layout(fixtures, path, BUCKETS, row_group_bytes=4096)
    for name in LAYOUTS:
        # a later session knows the path only
        spark.sql(f"DROP TABLE {table_name(path, name)}")
    return read_layout(spark, path, BUCKETS)


@pytest.fixture
def buckets_only(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "3000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_tables_keep_their_rows(fixtures, laid_out):
    for name in LAYOUTS:
        assert laid_out[name].exceptAll(fixtures[name]).isEmpty() and laid_out[name].count() == fixtures[name].count()


@pytest.mark.parametrize("name", ["collection", "debtors"])
def test_reports_have_the_same_rows(spark, fixtures, laid_out, name):
    want = sorted(map(tuple, R.REPORTS[name](fixtures, None, CONFIG).collect()), key=str)
    assert sorted(map(tuple, R.REPORTS[name](laid_out, None, CONFIG).collect()), key=str) == want and want


def test_balances_by_party_need_no_exchange(spark, laid_out, buckets_only):
    """Ledger, payments and invoices are summed by party where their buckets lie."""
    ledger = A.ledger_balance(laid_out["gl_entry"], laid_out["journal_entry"], CONFIG.ledger_start)
    paid = A.payment_party_totals(laid_out["payment_entry"], CONFIG.as_of)
    days = A.invoice_day_totals(laid_out["sales_invoice"])
    for df, key in ((ledger, "party"), (paid, "party"), (days, "customer")):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "Bucketed: true" in plan and not re.search(rf"Exchange hashpartitioning\({key}", plan), plan


def test_collection_report_has_no_exchange_above_the_facts(spark, laid_out, buckets_only):
    plan = R.report_collection(laid_out, None, CONFIG)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for table in ("gl_entry", "payment_entry"):
        at = next(i for i, x in enumerate(lines) if "FileScan" in x and f"/{table}.parquet" in x)
        depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
        above = []
        for x in reversed(lines[:at]):
            d = len(x) - len(x.lstrip(" :+-"))
            if d < depth:
                above.append(x.strip(" :+-"))
                depth = d
            if above and "Join" in above[-1]:
                break
        # from the scan up to the first join with another side's balances
        assert not any(x.startswith("Exchange") for x in above), above


def test_cut_off_skips_row_groups(spark, laid_out, buckets_only):
    """Rows before the ledger cut-off are not read where whole row groups or pages lie before it."""
    total = laid_out["gl_entry"].count()
    late = laid_out["gl_entry"].where("creation >= timestamp'1998-06-01 00:00:00'").select("party", "debit", "creation")
    found = late.count()
    read = _rows_read(late, "gl_entry")
    # row groups hold a hundred rows here; at most one a bucket lies across the cut-off
    assert 0 < found <= read[0] <= found + BUCKETS * 100 and read[0] < total
