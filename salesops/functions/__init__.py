"""Scalar Column expressions: calendar and number/text rules of the reports."""

from .dates import (as_date, calendar_parts, day_of_month, day_offset, days_passed_week, last_days,
                    month_days, monday_of, months_back, period_bounds, same_month,
                    same_period, same_quarter, same_week, sunday_week, week_days,
                    working_days_month, working_days_week)
from .numeric import (case_least, coalesce_zero, due_cutoff, flag_yn, floor_at_zero, format_amount,
                      payment_terms_days, per_crore, per_lakh, round_half_up, safe_divide, times)

__all__ = [n for n in dir() if not n.startswith("_")]
