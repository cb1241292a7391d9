"""Date expressions with boundary-crossing differences and an explicit 'today'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from covermetrics.functions.numbers import as_col


def month_of(c: Column | str) -> Column:
    return F.trunc(as_col(c).cast("date"), "month")


def quarter_of(c: Column | str) -> Column:
    return F.trunc(as_col(c).cast("date"), "quarter")


def month_index(c: Column | str) -> Column:
    c = as_col(c)
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def months_between_boundaries(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed: 31 Jan to 1 Mar is 2, not 1 whole month."""
    return month_index(end) - month_index(start)


def hours_between_boundaries(start: Column | str, end: Column | str) -> Column:
    def hour(c):
        return F.unix_seconds(F.date_trunc("hour", as_col(c)).cast("timestamp"))
    return ((hour(end) - hour(start)) / F.lit(3600)).cast("long")


def period_start(as_of: str, period: str) -> Column:
    """First day of the month, quarter or year that holds ``as_of``."""
    unit = {"MTD": "month", "QTD": "quarter", "YTD": "year"}[period]
    return F.trunc(F.lit(as_of).cast("date"), unit)


def fiscal_quarter_text(c: Column | str) -> Column:
    c = as_col(c)
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))


def fiscal_quarter_start(text: Column | str) -> Column:
    """'2024-Q3' to 2024-07-01."""
    t = as_col(text)
    year = F.substring(t, 1, 4).cast("int")
    quarter = F.substring(t, 7, 1).cast("int")
    return F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1))


def days_until(c: Column | str, as_of: str) -> Column:
    """Days from ``as_of``, never negative; NULL stays NULL."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.greatest(F.datediff(c, F.lit(as_of).cast("date")), F.lit(0)))
