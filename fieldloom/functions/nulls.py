"""Missing-value contract.

Spark and the statistical language these workloads come from disagree on missing values.
Each function states the rule it keeps; all are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice; a missing condition gives a missing result."""
    return F.when(condition, yes).when(~condition, no)


def is_in(c: ColumnLike, values: Iterable) -> Column:
    """Membership test that is never missing: a missing value is not a member."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def not_in(c: ColumnLike, values: Iterable) -> Column:
    """Keeps missing values, unlike SQL ``NOT IN``."""
    return ~is_in(c, values)


def matches(c: ColumnLike, pattern: str) -> Column:
    """Regular-expression test that is False, not missing, on missing text."""
    return F.coalesce(as_col(c).rlike(pattern), F.lit(False))


def paste(*parts, sep: str = "") -> Column:
    """Concatenate as text; a missing part is written as the text ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(_part(p).cast("string"), F.lit("NA")) for p in parts])


def _part(p) -> Column:
    return p if isinstance(p, Column) else F.lit(p)


def to_number(c: ColumnLike, dtype: str = "double") -> Column:
    """Text to number; malformed text becomes missing instead of an error."""
    return as_col(c).try_cast(dtype)


# --- aggregates ---------------------------------------------------------------------------


def any_missing(c: ColumnLike) -> Column:
    return F.count(as_col(c)) < F.count(F.lit(1))


def sum_strict(c: ColumnLike) -> Column:
    """Sum that is missing as soon as one value is."""
    return F.when(any_missing(c), None).otherwise(F.sum(as_col(c)))


def mean_strict(c: ColumnLike) -> Column:
    """Mean that is missing as soon as one value is."""
    return F.when(any_missing(c), None).otherwise(F.avg(as_col(c)))


def sum_skip(c: ColumnLike) -> Column:
    """Sum without missing values; zero when nothing is left."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0))


def mean_skip(c: ColumnLike) -> Column:
    """Mean without missing values; missing when nothing is left."""
    return F.avg(as_col(c))


def weighted_mean(value: ColumnLike, weight: ColumnLike) -> Column:
    """Weighted mean; any missing value or weight makes it missing."""
    v, w = as_col(value), as_col(weight)
    return F.when(any_missing(v * w), None).otherwise(
        F.try_divide(F.sum(v * w), F.sum(w)))


# --- row-wise ------------------------------------------------------------------------------


def row_sum(columns: Iterable[ColumnLike], skip_missing: bool = False) -> Column:
    """Sum across the columns of one row."""
    total = None
    for c in columns:
        term = F.coalesce(as_col(c), F.lit(0)) if skip_missing else as_col(c)
        total = term if total is None else total + term
    return total


def first_present(columns: Iterable[ColumnLike]) -> Column:
    """First value that is not missing, in column order."""
    return F.coalesce(*[as_col(c) for c in columns])
