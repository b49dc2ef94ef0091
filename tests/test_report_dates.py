"""Whole reports at awkward report dates against the oracle at the same date:
a Sunday, a month end, a quarter start, New Year's day, a leap day."""

import datetime as dt

import pytest

from salesops.plans import reports as R
from salesops.plans.compare import canonical, compare
from salesops.plans.oracles import ORACLES, render
from salesops.plans.params import CONFIG

from .conftest import SF_SMALL

DATES = [dt.date(1998, 7, 19), dt.date(1998, 6, 30), dt.date(1998, 7, 1), dt.date(1998, 4, 1),
         dt.date(1999, 1, 1), dt.date(1996, 2, 29)]
REPORTS = {
    "report_collection": R.report_collection,
    "report_dashboard": R.report_dashboard,
    "report_debtors": R.report_debtors,
    "report_funnel": R.report_funnel,
}


@pytest.mark.parametrize("as_of", DATES, ids=str)
@pytest.mark.parametrize("name", list(REPORTS))
def test_report_at_date(spark, fixtures, name, as_of):
    df = canonical(REPORTS[name](fixtures, None, CONFIG.with_(as_of=as_of)))
    res = compare(df, render(ORACLES[name], as_of=as_of), SF_SMALL)
    assert res["schema_match"] and res["value_match"], res


@pytest.mark.parametrize("as_of", [dt.date(2024, 1, 14), dt.date(2024, 1, 1), dt.date(2023, 12, 31)], ids=str)
def test_appointment_at_date(spark, fixtures, as_of):
    df = canonical(R.report_appointment(fixtures, None, CONFIG.with_(as_of=as_of)))
    res = compare(df, render(ORACLES["report_appointment"], todo_as_of=as_of), SF_SMALL)
    assert res["schema_match"] and res["value_match"], res
