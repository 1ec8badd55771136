"""Joins under the rule that a missing key matches a missing key.

Spark plans ``<=>`` as a hash or sort-merge join, so null-safety costs no extra shuffle. No side
is broadcast by hint here: Spark broadcasts by measured size, and AQE splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

SIDES = ("left", "right", "outer", "inner", "left_anti", "left_semi")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str] | Mapping[str, str],
                   how: str = "left", suffix: tuple[str, str] = ("", "_right")) -> DataFrame:
    """Equi-join on ``keys`` (names, or ``{left: right}``), one key column in the result.

    Columns that both sides have besides the keys get the suffixes. A full join is put together
    from a left join and the right rows without a match: unlike a full join, those let Spark
    broadcast a small right side and split a key that holds a large share of the rows.
    """
    if how not in SIDES:
        raise ValueError(f"how must be one of {SIDES}")
    pairs = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    if not pairs:
        raise ValueError("a join needs at least one key")
    if how == "outer":
        return _full_join(left, right, pairs, suffix)
    right_keys = set(pairs.values())
    right_in = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") for c in right.columns])
    condition = reduce(lambda a, b: a & b,
                       [left[f"`{a}`"].eqNullSafe(right_in[f"`__r_{b}`"]) for a, b in pairs.items()])
    joined = left.join(right_in, condition, how)
    if how in ("left_anti", "left_semi"):
        return joined
    out = []
    for c in left.columns:
        if c in pairs:
            out.append(_key(c, pairs[c], how).alias(c))
        else:
            clash = c in right.columns and c not in right_keys
            out.append(F.col(f"`{c}`").alias(c + suffix[0] if clash else c))
    for c in right.columns:
        if c in right_keys:
            continue
        clash = c in left.columns and c not in pairs
        out.append(F.col(f"`__r_{c}`").alias(c + suffix[1] if clash else c))
    return joined.select(*out)


def _key(left: str, right: str, how: str) -> Column:
    return F.col(f"`__r_{right}`") if how == "right" else F.col(f"`{left}`")


def _full_join(left: DataFrame, right: DataFrame, pairs: Mapping[str, str], suffix: tuple[str, str]) -> DataFrame:
    matched = null_safe_join(left, right, pairs, "left", suffix)
    known = left.select(*[F.col(f"`{a}`").alias(b) for a, b in pairs.items()]).distinct()
    unmatched = null_safe_join(right, known, list(pairs.values()), "left_anti")
    names = {}
    for c in right.columns:
        back = {b: a for a, b in pairs.items()}
        clash = c not in back and c in left.columns and c not in pairs
        names[c] = back.get(c, c + suffix[1] if clash else c)
    renamed = unmatched.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return matched.unionByName(renamed, allowMissingColumns=True)


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every column that both sides have."""
    shared = [c for c in left.columns if c in right.columns]
    return null_safe_join(left, right, shared, how)


def lookup_join(left: DataFrame, table: DataFrame, keys: Sequence[str] | Mapping[str, str],
                fixed: Sequence[tuple], how: str = "left") -> DataFrame:
    """Join the table made from a fixed list, sent to every executor when the list is short."""
    return null_safe_join(left, F.broadcast(table) if len(fixed) <= 10_000 else table, keys, how)


def map_keys(df: DataFrame, mapping: DataFrame, columns: Sequence[str], source: str = "from_key",
             target: str = "to_key") -> DataFrame:
    """Bring ids to another naming by a user-supplied mapping; unmapped ids stay as they are.

    An id mapped twice is an error.
    """
    out = df
    for c in columns:
        pairs = assert_unique(mapping.select(F.col(source).alias("__from"), F.col(target).alias("__to")), ["__from"])
        out = null_safe_join(out, pairs, {c: "__from"}, "left")
        out = out.withColumn(c, F.coalesce("__to", c)).drop("__to")
    return out.select(*df.columns)


def row_stats(df: DataFrame, aggs: Mapping[str, Column]) -> Column:
    """Whole-table aggregates as one struct column: a one-row scalar subquery, not a join."""
    return df.agg(F.struct(*[c.alias(name) for name, c in aggs.items()]).alias("s")).scalar()


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
                     source: DataFrame | None = None, written: bool = False) -> DataFrame:
    """Put group aggregates on every row.

    Aggregates first (partial sums on the map side) and joins the small result back, so a group
    that holds a third of the rows never has to fit in one task as it would with a window.
    ``written`` writes the aggregates first: the planner then knows their size and, if it is small, shuffles no
    row for the join. For tables that are cheap to read twice.
    """
    stats = (source if source is not None else df).groupBy(*keys).agg(
        *[c.alias(name) for name, c in aggs.items()])
    stats = cut_lineage(stats) if written else stats
    base = df.select(*[c for c in df.columns if c not in aggs])
    return null_safe_join(base, stats, keys, "left")


def fill_from_group(df: DataFrame, column: str, keys: Sequence[str], plot_columns: Sequence[str],
                    where: Column | None = None, apply_to: Column | None = None,
                    mean_column: str | None = None) -> DataFrame:
    """Fill missing values with a group mean taken over distinct plot-level rows.

    ``plot_columns`` name the plot-level columns; several detail rows of one plot count once.
    ``where`` limits the rows the mean is taken from, ``apply_to`` the rows that are filled.
    ``mean_column`` keeps the group mean under that name.
    """
    levels = list(dict.fromkeys([*plot_columns, *keys, column]))
    source = df if where is None else df.where(where)
    plots = source.select(*levels).distinct()
    name = mean_column or "__mean"
    out = with_group_stats(df, keys, {name: F.avg(column)}, source=plots)
    fill = F.col(column).isNull() & (F.lit(True) if apply_to is None else apply_to)
    out = out.withColumn(column, F.when(fill, F.col(name)).otherwise(F.col(column)))
    order = [*df.columns, *([name] if mean_column else [])]
    return out.select(*order)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table itself, with a run-time error as soon as a key occurs twice."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(1)
    checked = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(
        f"duplicate key in {list(keys)}"))).otherwise(F.any_value(row))
    one = df.groupBy(*keys).agg(checked.alias("__row"))
    return one.select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c)
                        for c in df.columns])
