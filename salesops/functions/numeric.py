"""Number and text expressions with the database's NULL/zero rules.

Spark runs with ANSI semantics, under which several database idioms raise or
differ; each helper here gives the database result:

* ``GREATEST(x, 0)`` is NULL when ``x`` is NULL (Spark's ``greatest`` skips NULLs).
* ``x / 0`` is NULL (ANSI Spark raises): ``try_divide``.
* ``CAST('' AS UNSIGNED)`` is 0 and NULL stays NULL (ANSI Spark raises).
* ``ROUND`` on decimals is half-up in both; keep money decimal until the end.
* ``FORMAT(x, 2)`` rounds half-up; Spark's ``format_number`` alone rounds
  half-even, so round first.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PER_CRORE, PER_LAKH


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_at_zero(x: Column | str) -> Column:
    """``GREATEST(x, 0)`` keeping NULL."""
    x = col(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(x, F.lit(0)))


def case_least(x: Column | str, cap: Column | str) -> Column:
    """``CASE WHEN x > cap THEN cap ELSE x END`` (NULL on either side gives ``x``)."""
    x, cap = col(x), col(cap)
    return F.when(x > cap, cap).otherwise(x)


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """``a / b`` that is NULL for a zero divisor."""
    return F.try_divide(col(a), col(b))


def round_half_up(x: Column | str, scale: int = 2) -> Column:
    return F.round(col(x), scale)


def per_lakh(x: Column | str) -> Column:
    """``x / 100000`` as an exact decimal multiplication."""
    return col(x) * F.lit(PER_LAKH)


def per_crore(x: Column | str) -> Column:
    """``x / 10000000`` as an exact decimal multiplication."""
    return col(x) * F.lit(PER_CRORE)


def times(x: Column | str, factor: int | Decimal) -> Column:
    return col(x) * F.lit(factor)


def format_amount(x: Column | str, scale: int = 2) -> Column:
    """``FORMAT(x, 2)``: text with thousands separators, rounded half-up."""
    return F.format_number(F.round(col(x), scale), scale)


def payment_terms_days(terms: Column | str) -> Column:
    """``CAST(REGEXP_REPLACE(terms, '[^0-9]', '') AS UNSIGNED)``.

    All digits are glued ("Net 30, 45" gives 3045); no digits gives 0; NULL
    stays NULL; a number too large for BIGINT gives NULL.
    """
    terms = col(terms)
    digits = F.regexp_replace(terms, r"[^0-9]", "")
    return (F.when(terms.isNull(), F.lit(None).cast("bigint"))
            .when(digits == "", F.lit(0).cast("bigint"))
            .otherwise(digits.try_cast("bigint")))


def coalesce_zero(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(0))


def flag_yn(x: Column | str) -> Column:
    """``CASE WHEN x = 1 THEN 'Y' ELSE 'N' END``."""
    return F.when(col(x) == 1, F.lit("Y")).otherwise(F.lit("N"))


# Earliest date the database represents; date arithmetic below it gives NULL.
MIN_SQL_DATE = "1000-01-01"
_MAX_OFFSET_DAYS = 3_000_000


def due_cutoff(as_of: Column, terms: Column | str, shift_days: int = 0) -> Column:
    """``DATE_SUB(DATE_ADD(as_of, INTERVAL shift DAY), INTERVAL terms DAY)``.

    NULL terms give NULL, as does a result before the database's first date
    (terms too large); the offset is clamped first so Spark never overflows.
    """
    terms = col(terms)
    clamped = F.least(terms, F.lit(_MAX_OFFSET_DAYS)).cast("int")
    d = F.date_sub(F.date_add(as_of, shift_days), clamped)
    return F.when(terms.isNull() | (d < F.lit(MIN_SQL_DATE).cast("date")), F.lit(None).cast("date")).otherwise(d)
