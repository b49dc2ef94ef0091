"""Sources and sinks: tables written and read back in another format give the same report."""

import datetime as dt

import duckdb
import pytest

from salesops.plans import reports as R
from salesops.plans.compare import canonical
from salesops.plans.params import CONFIG
from salesops.sources import SCHEMAS, read_tables, write_tables
from salesops.sources.loader import jdbc_plan


def test_orc_round_trip(spark, stored, tmp_path):
    write_tables(stored, str(tmp_path), fmt="orc")
    orc = read_tables(spark, str(tmp_path), fmt="orc")
    assert set(orc) == set(SCHEMAS)
    for name in SCHEMAS:
        assert orc[name].schema == stored[name].schema
    a = canonical(R.report_debtors(stored, None, CONFIG)).collect()
    b = canonical(R.report_debtors(orc, None, CONFIG)).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str) and len(a) > 0


def test_row_counts_match_fixture(spark, fixtures, stored):
    for name in ("customer", "sales_invoice", "todo", "daily_achievement"):
        assert fixtures[name].count() == stored[name].count()


def test_jdbc_facts_are_sliced():
    """No database runs here: the plan of the reads is tested."""
    span = (dt.date(2024, 1, 1), dt.date(2024, 12, 31), 4)
    how, slices = jdbc_plan("gl_entry", {}, span)
    assert how == "slices" and len(slices) == 4
    days = [None, dt.date(1990, 1, 1), *(dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(800))]
    con = duckdb.connect()
    for d in days:
        value = "NULL::DATE" if d is None else f"DATE '{d}'"
        hits = [con.sql(f"SELECT coalesce({p.replace('`creation`', value)}, false)").fetchall()[0][0] for p in slices]
        assert sum(hits) == 1
    assert jdbc_plan("gl_entry", {"gl_entry": ("idx", 0, 9, 3)}, None) == ("range", ("idx", 0, 9, 3))
    assert jdbc_plan("sales_person", {}, None) == ("whole", None)
    for grows in ("address", "customer_credit_limit", "party_account"):
        assert jdbc_plan(grows, {}, span)[0] == "slices"
    with pytest.raises(ValueError):
        jdbc_plan("payment_entry", {}, None)
