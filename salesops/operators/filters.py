"""Row filters of the reports (visibility, exclusions, document state)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DateLike, as_date, months_back


def visible_to(df: DataFrame, user: str | None, zonal_head: str = "zonal_head", bd: str = "bd",
               business_head: str = "business_head") -> DataFrame:
    """Rows the user may see: ``zonal_head = u OR bd = u OR business_head = u``.

    ``user=None`` applies no filter (an administrator's view).
    """
    if user is None:
        return df
    u = F.lit(user)
    return df.where((F.col(zonal_head) == u) | (F.col(bd) == u) | (F.col(business_head) == u))


def not_in_values(c: Column | str, values: Sequence[str | None]) -> Column:
    """``c NOT IN (v1, v2, ...)`` with SQL three-valued logic: a NULL ``c``, or a
    NULL in the list without a match, gives NULL and so drops the row."""
    c = F.col(c) if isinstance(c, str) else c
    return ~c.isin(list(values))


def exclude_values(df: DataFrame, column: str, values: Sequence[str | None]) -> DataFrame:
    return df.where(not_in_values(column, values))


def submitted(df: DataFrame, docstatus: str = "docstatus") -> DataFrame:
    """``docstatus = 1`` (submitted documents)."""
    return df.where(F.col(docstatus) == 1)


def with_status(df: DataFrame, status: str, column: str = "status") -> DataFrame:
    return df.where(F.col(column) == F.lit(status))


def on_or_after(df: DataFrame, column: str, start) -> DataFrame:
    """``column >= start``; a typed literal (read in the session time zone for
    timestamps) so the predicate reaches the scan."""
    c = F.col(column)
    return df.where(c >= F.lit(str(start)).cast(df.schema[column].dataType))


def open_recent_todos(todo: DataFrame, as_of: DateLike, months: int = 2) -> DataFrame:
    """Open todos dated on or after ``as_of - months``."""
    return todo.where((F.col("status") == "Open") & (F.col("date") >= months_back(as_date(as_of), months)))


def product_line(df: DataFrame, line: str, column: str = "transaction_type") -> DataFrame:
    return df.where(F.col(column) == F.lit(line))
