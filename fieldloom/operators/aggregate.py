"""Group aggregates, group filters and duplicate checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.nulls import ColumnLike, as_col
from .joins import null_safe_join, with_group_stats
from .ordered import first_row


def two_stage(df: DataFrame, inner_keys: Sequence[str], inner: Mapping[str, Column],
              outer_keys: Sequence[str], outer: Mapping[str, Column]) -> DataFrame:
    """Aggregate of an aggregate, such as the mean over years of yearly sums."""
    first = df.groupBy(*inner_keys).agg(*[c.alias(n) for n, c in inner.items()])
    return first.groupBy(*outer_keys).agg(*[c.alias(n) for n, c in outer.items()])


def keep_groups(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Keep all rows of the groups for which an aggregate condition holds."""
    kept = df.groupBy(*keys).agg(condition.alias("__keep")).where("__keep").select(*keys)
    return null_safe_join(df, kept, keys, "left_semi")


def group_size(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Number of rows of the group on every row."""
    return with_group_stats(df, keys, {out: F.count(F.lit(1))})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def drop_known_bad(df: DataFrame, bad: Column) -> DataFrame:
    """Drop rows known to be bad; a row for which that cannot be told is dropped too."""
    return df.where(~bad)


def drop_duplicates_missing(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Of keys that occur twice, drop the rows that miss a value."""
    sized = group_size(df, keys, "__n")
    return drop_known_bad(sized, (F.col("__n") == 2) & F.col(column).isNull()).drop("__n")


def first_within(df: DataFrame, scope: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key among the rows in scope; other rows stay untouched."""
    inside = F.coalesce(scope, F.lit(False))
    return df.where(~inside).unionByName(first_row(df.where(inside), keys, order))


def group_difference(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "diff") -> DataFrame:
    """Difference to the row before, for already summarised series (few rows per group)."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn(out, F.col(value) - before).where(F.col(out).isNotNull())


def ratio_percent(part: ColumnLike, whole: ColumnLike) -> Column:
    return F.try_divide(as_col(part), as_col(whole)) * 100


def group_distinct(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Number of distinct values of the group on every row.

    Distinct pairs first, then a count: two aggregates with partial steps, no value sets in memory.
    """
    pairs = df.where(F.col(column).isNotNull()).select(*keys, column).distinct()
    out_df = with_group_stats(df, keys, {out: F.count(F.lit(1))}, source=pairs)
    return out_df.withColumn(out, F.coalesce(out, F.lit(0)))


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; a column that one lacks is missing there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
