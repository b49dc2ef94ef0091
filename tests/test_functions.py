"""Scalar rules: calendar and number edge cases against plain Python."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from salesops.functions import dates as D
from salesops.functions import numeric as N


def _mode0_week(d: dt.date) -> int:
    # week 1 starts on the year's first Sunday; earlier days are week 0
    jan1 = dt.date(d.year, 1, 1)
    first_sunday = jan1 + dt.timedelta(days=(6 - jan1.weekday()) % 7)
    return 0 if d < first_sunday else (d - first_sunday).days // 7 + 1


def test_sunday_week_matches_mode0_2015_2030(spark):
    start = dt.date(2015, 1, 1)
    n = (dt.date(2030, 12, 31) - start).days + 1
    df = spark.range(n).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("d"))
    got = {r.d: r.w for r in df.select("d", D.sunday_week("d").alias("w")).collect()}
    assert len(got) == n
    assert all(w == _mode0_week(d) for d, w in got.items())


def test_same_period_range_equals_number_and_year(spark):
    start = dt.date(2019, 12, 1)
    df = spark.range(500).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("d"))
    for as_of in [dt.date(2019, 12, 31), dt.date(2020, 1, 1), dt.date(2020, 1, 4), dt.date(2020, 1, 5),
                  dt.date(2020, 2, 29), dt.date(2020, 3, 31), dt.date(2020, 12, 27)]:
        for unit in ("week", "month", "quarter"):
            number = {"week": D.sunday_week, "month": F.month, "quarter": F.quarter}[unit]
            a = F.lit(as_of)
            rows = df.select(D.same_period("d", as_of, unit).alias("r"),
                             ((number(F.col("d")) == number(a)) & (F.year("d") == F.year(a))).alias("n")).collect()
            assert all(r.r == r.n for r in rows), (as_of, unit)


def test_working_days(spark):
    cases = {
        dt.date(1998, 7, 15): (6, 3, 27, 15),   # Wednesday
        dt.date(1998, 7, 19): (6, 6, 27, 19),   # Sunday: Mon..Sat all passed
        dt.date(1998, 7, 13): (6, 1, 27, 13),   # Monday
        dt.date(2024, 2, 29): (6, 4, 25, 29),   # leap day, Thursday
        dt.date(2023, 12, 31): (6, 6, 26, 31),  # year end, Sunday
    }
    for as_of, want in cases.items():
        a = F.lit(as_of)
        r = spark.range(1).select(D.working_days_week(a), D.days_passed_week(a), D.working_days_month(a),
                                  D.day_of_month(a)).first()
        assert tuple(r) == want, as_of


def test_months_back_clamps(spark):
    r = spark.range(1).select(D.months_back(F.lit(dt.date(2024, 4, 30)), 2).alias("a"),
                              D.months_back(F.lit(dt.date(2023, 5, 31)), 3).alias("b")).first()
    assert r.a == dt.date(2024, 2, 29) and r.b == dt.date(2023, 2, 28)


def test_payment_terms_days(spark):
    vals = [("Net 30 days", 30), ("Net 30, 45", 3045), ("Advance", 0), ("", 0), (None, None),
            ("15 Days", 15), ("9" * 25, None)]
    df = spark.createDataFrame([(v,) for v, _ in vals], "t string")
    got = [r.d for r in df.select(N.payment_terms_days("t").alias("d")).collect()]
    assert got == [w for _, w in vals]


def test_floor_divide_format_rules(spark):
    df = spark.createDataFrame([(None, 1), (Decimal(-5), 0), (Decimal(7), 2)], "x decimal(10,2), y int")
    rows = df.select(N.floor_at_zero("x").alias("f"), N.safe_divide("x", "y").alias("q"),
                     N.case_least("x", F.lit(3)).alias("c")).collect()
    assert [r.f for r in rows] == [None, 0, 7]
    assert rows[1].q is None and float(rows[2].q) == 3.5
    assert rows[0].c is None and float(rows[1].c) == -5 and float(rows[2].c) == 3
    fmt = spark.createDataFrame([("2.125",), ("1234567.005",), ("-0.005",)], "s string").select(
        N.format_amount(F.col("s").cast("decimal(20,3)")).alias("t")).collect()
    assert [r.t for r in fmt] == ["2.13", "1,234,567.01", "-0.01"]


def test_due_cutoff(spark):
    df = spark.createDataFrame([(30,), (None,), (0,), (10 ** 12,)], "t bigint")
    got = [r.c for r in df.select(N.due_cutoff(F.lit(dt.date(1998, 7, 15)), "t", 1).alias("c")).collect()]
    assert got == [dt.date(1998, 6, 16), None, dt.date(1998, 7, 16), None]


def test_period_bounds(spark):
    def bounds(day, unit):
        return tuple(spark.range(1).select(*D.period_bounds(day, unit)).first())

    assert bounds(dt.date(2021, 1, 1), "week") == (dt.date(2021, 1, 1), dt.date(2021, 1, 2))
    assert bounds(dt.date(2020, 12, 31), "week") == (dt.date(2020, 12, 27), dt.date(2020, 12, 31))
    assert bounds(dt.date(1998, 7, 15), "quarter") == (dt.date(1998, 7, 1), dt.date(1998, 9, 30))
    assert bounds(dt.date(2024, 2, 10), "month") == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))

