"""Column selection, derivation, recoding and ordered categories."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lookups import level_order
from ..functions.nulls import ColumnLike, as_col
from .joins import assert_unique, null_safe_join, row_stats
from .ordered import rank_table

#: Residuals in units of their standard deviation, and their squares: steps of 1e-20, sums up to 10^18.
RESIDUAL_TYPE = "decimal(38,20)"


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from ``first`` to ``last``, both included, in table order."""
    names = df.columns
    i, j = names.index(first), names.index(last)
    return names[i:j + 1] if i <= j else names[j:i + 1][::-1]


def cols_matching(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns in which the pattern is found."""
    return [c for c in df.columns if re.search(pattern, c)]


def select_as(df: DataFrame, **renamed: str) -> DataFrame:
    """Select, reorder and rename: ``select_as(df, new="old")``."""
    return df.select(*[F.col(old).alias(new) for new, old in renamed.items()])


def rename(df: DataFrame, **renamed: str) -> DataFrame:
    """Rename in place: ``rename(df, new="old")``."""
    missing = [old for old in renamed.values() if old not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed({old: new for new, old in renamed.items()})


def derive(df: DataFrame, **steps: Column) -> DataFrame:
    """Add columns one after the other; a later step sees the result of an earlier one."""
    for name, value in steps.items():
        df = df.withColumn(name, value)
    return df


def across(df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one function to many columns."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def patch_cells(df: DataFrame, corrections: DataFrame, keys: Sequence[str],
                columns: Sequence[str], only_missing: bool = False) -> DataFrame:
    """Overwrite single cells from a keyed table of corrections.

    A missing correction leaves the cell as it is. With ``only_missing`` only empty cells are
    filled. Corrections that repeat a key are an error.
    """
    marked = assert_unique(corrections.select(*keys, *[F.col(c).alias(f"__fix_{c}") for c in columns]), keys)
    joined = null_safe_join(df, marked, keys, "left")
    fixed = {}
    for c in columns:
        old, new = F.col(c), F.col(f"__fix_{c}")
        fixed[c] = F.coalesce(old, new) if only_missing else F.coalesce(new, old)
    return joined.withColumns(fixed).select(*df.columns)


def as_levels(c: ColumnLike, levels: Sequence) -> tuple[Column, Column]:
    """Ordered category: the value (missing when it is not a level) and its position."""
    position = level_order(c, levels)
    return F.when(position.isNotNull(), as_col(c)), position


def dummies(df: DataFrame, column: str, levels: Sequence, reference) -> tuple[DataFrame, list[str]]:
    """0/1 columns for every level but the reference; missing stays missing."""
    if reference not in levels:
        raise ValueError(f"{reference!r} is not one of {list(levels)}")
    new = {f"{column}{lv}": (F.col(column) == F.lit(lv)).cast("double")
           for lv in levels if lv != reference}
    return df.withColumns(new), list(new)


def order_levels_by(df: DataFrame, column: str, value: str, out: str = "level_order") -> DataFrame:
    """Rank the levels of a column by the mean of a value (ties by level), as a level table."""
    means = df.groupBy(column).agg(F.avg(value).alias(f"mean_{value}"))
    return rank_table(means, [f"mean_{value}", column], out)


def zscore(df: DataFrame, columns: Mapping[str, str], center_only: bool = False,
           divisors: Mapping[str, float] | None = None) -> DataFrame:
    """Standardise ``{new: old}`` columns over the whole table; missing and infinite values are skipped.

    An infinite value stays infinite and changes no other row. ``divisors`` rescales a column before it is centred.
    """
    divisors = divisors or {}
    scaled = {new: F.col(old) / F.lit(float(divisors.get(old, 1.0))) for new, old in columns.items()}
    out = df.withColumn("__stats", _exact_stats(df, scaled))
    for new, value in scaled.items():
        centred = value - F.col("__stats")[f"{new}__m"]
        if not center_only:
            centred = F.try_divide(centred, F.col("__stats")[f"{new}__s"])
        out = out.withColumn(new, centred)
    return out.drop("__stats")


def _exact_stats(df: DataFrame, values: Mapping[str, Column]) -> Column:
    """Mean ``<name>__m`` and standard deviation ``<name>__s`` of the finite values, free of the rounding of long sums.

    A plain average loses digits with the number of rows and depends on the order in which tasks finish. Here it only sets
    the scale: residuals in units of the first standard deviation are summed as decimals, which is exact in any order.
    """
    finite = df.select(*[F.when(F.abs(value) < float("inf"), value).alias(new) for new, value in values.items()])
    first = row_stats(finite, {k: c for new in values for k, c in (
        (f"{new}__m", F.avg(f"`{new}`")), (f"{new}__s", F.stddev_samp(f"`{new}`")))})
    work = finite.withColumn("__first", first)
    found = {}
    for new in values:
        m, s = F.col("__first")[f"{new}__m"], F.col("__first")[f"{new}__s"]
        residual = F.try_divide(F.col(f"`{new}`") - m, s)
        total, squares = (F.sum(c.cast(RESIDUAL_TYPE)).cast("double") for c in (residual, residual * residual))
        n, m, s = F.count(residual), F.max(m), F.max(s)
        found[f"{new}__m"] = F.coalesce(m + s * F.try_divide(total, n), m)
        found[f"{new}__s"] = F.coalesce(s * F.sqrt(F.try_divide(squares - F.try_divide(total * total, n), n - 1)), s)
    return row_stats(work, found)
