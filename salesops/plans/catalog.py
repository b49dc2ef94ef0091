"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the fixture CRM tables derived from the driver files in
``sf_dir`` (so its work grows with them) and returns comparison-typed
columns (see ``compare.canonical``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.loader import cached_fixture_tables
from . import reports as R
from .compare import canonical
from .params import CONFIG, TODO_CONFIG

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return canonical(fn(cached_fixture_tables(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


@register("report_funnel")
def _report_funnel(t):
    """The funnel report for all business heads."""
    return R.report_funnel(t, None, CONFIG)


@register("report_zero_order")
def _report_zero_order(t):
    """One zero-order customer per bd."""
    return R.report_zero_order(t, None, CONFIG)


@register("report_collection")
def _report_collection(t):
    """Collection report for all business heads."""
    return R.report_collection(t, None, CONFIG)


@register("report_debtors")
def _report_debtors(t):
    """Debtor report for all business heads."""
    return R.report_debtors(t, None, CONFIG)


@register("report_dashboard")
def _report_dashboard(t):
    """R2: dashboard, numbers and formatted text."""
    return R.report_dashboard(t, None, CONFIG)


@register("report_appointment")
def _report_appointment(t):
    """Appointments on 2024-01-17."""
    return R.report_appointment(t, None, TODO_CONFIG)


@register("report_appointment_ignore_case")
def _report_appointment_ignore_case(t):
    """R1 with user ids compared without regard to case."""
    return R.report_appointment(t, None, TODO_CONFIG.with_(ignore_case=True))


from . import operator_queries  # noqa: E402,F401  (registers the operator queries)
