"""Calendar functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from .nulls import ColumnLike, as_col


def month_key(c: ColumnLike) -> Column:
    """``2018-07`` style month label."""
    return F.date_format(as_col(c), "yyyy-MM")


def within_years(c: ColumnLike, first: int, last: int) -> Column:
    """In the years ``first`` to ``last``, as a range of the column that reaches the file scan."""
    return (as_col(c) >= F.lit(date(first, 1, 1))) & (as_col(c) < F.lit(date(last + 1, 1, 1)))


def month_start(year: ColumnLike, month: ColumnLike) -> Column:
    """First day of a month given as two numbers."""
    return F.make_date(as_col(year).cast("int"), as_col(month).cast("int"), F.lit(1))


def parse_day_month_year(c: ColumnLike) -> Column:
    """Day-month-year text with any separator; malformed text becomes missing."""
    tidy = F.regexp_replace(F.trim(as_col(c)), "[^0-9]+", "/")
    return F.try_to_date(tidy, "d/M/yyyy")


def parse_year_month_day(c: ColumnLike) -> Column:
    tidy = F.regexp_replace(F.trim(as_col(c)), "[^0-9]+", "-")
    return F.try_to_date(tidy, "yyyy-M-d")


def parse_month_year(c: ColumnLike) -> Column:
    """Month-year text with any separator, as the first day of that month."""
    tidy = F.regexp_replace(F.trim(as_col(c)), "[^0-9]+", "/")
    return F.try_to_date(F.concat(F.lit("1/"), tidy), "d/M/yyyy")


def day_number_to_date(c: ColumnLike, origin: str) -> Column:
    return F.date_add(F.to_date(F.lit(origin)), as_col(c).cast("int"))


def months_from(start: ColumnLike, end: ColumnLike) -> Column:
    """Months between two dates (whole when both are the first of a month)."""
    return F.months_between(as_col(end), as_col(start))


def season_of_month(month: ColumnLike) -> Column:
    """Season label of the drought series."""
    m = as_col(month)
    return (F.when(m.between(3, 5), "2").when(m.between(6, 7), "early")
            .when(m.between(8, 11), "late").otherwise("1"))


def phase_of_month(month: ColumnLike, first: str, second: str, other: str | None = None) -> Column:
    """June and July against August and September."""
    m = as_col(month)
    return F.when(m.isin(6, 7), first).when(m.isin(8, 9), second).otherwise(F.lit(other))


def year_of_code(c: ColumnLike) -> Column:
    """Year of a season code such as ``aut_09``."""
    return F.concat(F.lit("20"), F.substring(as_col(c), 5, 2)).try_cast("int")


def mid_month_day_of_year(month: ColumnLike) -> Column:
    """Day of the (non-leap) year in the middle of a month, used for solar radiation."""
    days = F.array(*[F.lit(d) for d in MID_MONTH_DAYS])
    return F.element_at(days, as_col(month).cast("int"))


# Day of a non-leap year halfway through each month.
MID_MONTH_DAYS = (15, 46, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349)
