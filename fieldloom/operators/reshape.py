"""Wide to long, long to wide, and row generation."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import paste
from ..functions.uniform import hash32
from ..session import cut_lineage
from .joins import null_safe_join
from .ordered import even_chunks, running_sum

PAIRS_PER_CELL = 1_000_000


def to_long(df: DataFrame, columns: Sequence[str], names_to: str = "name",
            values_to: str = "value", drop_missing: bool = False, as_text: bool = False) -> DataFrame:
    """One row per column of ``columns``; a narrow step without a shuffle."""
    ids = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    values = [F.col(f"`{c}`").cast("string").alias(c) if as_text else F.col(f"`{c}`")
              for c in columns]
    out = df.select(*ids, *values).unpivot(ids, [F.col(f"`{c}`") for c in columns],
                                           names_to, values_to)
    return out.where(F.col(values_to).isNotNull()) if drop_missing else out


def to_long_by_pattern(df: DataFrame, columns: Sequence[str], names_to: Sequence[str],
                       pattern: str, values_to: str = "value", as_text: bool = False) -> DataFrame:
    """Wide to long, the column name split into several columns by the groups of a pattern.

    The name ``.value`` in ``names_to`` marks the part that names the output column, so several
    measures become columns side by side.
    """
    parts = {}
    for c in columns:
        found = re.search(pattern, c)
        if found is None:
            raise ValueError(f"column {c!r} does not match {pattern!r}")
        parts[c] = dict(zip(names_to, found.groups()))
    measures = (list(dict.fromkeys(p[".value"] for p in parts.values()))
                if ".value" in names_to else [values_to])
    labels = [n for n in names_to if n != ".value"]
    rows: dict[tuple, dict[str, str]] = {}
    for c, p in parts.items():
        key = tuple(p[n] for n in labels)
        rows.setdefault(key, {})[p.get(".value", values_to)] = c
    types = {m: next(df.schema[r[m]].dataType for r in rows.values() if m in r) for m in measures}

    def cell(row: Mapping[str, str], m: str) -> Column:
        value = F.col(f"`{row[m]}`") if m in row else F.lit(None).cast(types[m])
        return (value.cast("string") if as_text else value).alias(m)

    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(labels, key)],
                        *[cell(row, m) for m in measures]) for key, row in rows.items()]
    ids = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in ids], F.explode(F.array(*structs)).alias("__s")).select(
        *[F.col(f"`{c}`") for c in ids], *[F.col(f"__s.{c}").alias(c) for c in [*labels, *measures]])


def to_wide(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
            names: Sequence, prefix: str = "", on_duplicate: str = "error", more: Mapping[str, Column] | None = None) -> DataFrame:
    """Long to wide for a declared list of names: one aggregate, one shuffle on ``ids``.

    Two values for one cell are an error unless ``on_duplicate`` is ``min`` or ``max``. ``more`` adds aggregates of the same rows.
    """
    cells = []
    for n in names:
        hit = F.col(names_from).eqNullSafe(F.lit(n))
        value = F.when(hit, F.col(values_from))
        if on_duplicate == "error":
            cell = F.when(F.count_if(hit) > 1, F.raise_error(F.lit(
                f"several values of {values_from} for {n}"))).otherwise(F.max(value))
        else:
            cell = F.min(value) if on_duplicate == "min" else F.max(value)
        cells.append(cell.alias(f"{prefix}{n}"))
    return df.groupBy(*ids).agg(*cells, *[c.alias(name) for name, c in (more or {}).items()])


def split_column(df: DataFrame, column: str, sep: str, names: Sequence[str]) -> DataFrame:
    """Split text on a delimiter into named columns, in place of the column."""
    new = [F.split_part(F.col(column), F.lit(sep), F.lit(i)).alias(n)
           for i, n in enumerate(names, start=1)]
    return df.select(*[x for c in df.columns for x in (new if c == column else [F.col(f"`{c}`")])])


def repeat_rows(df: DataFrame, weight: str, index: str | None = None) -> DataFrame:
    """Repeat each row ``weight`` times and drop the weight; zero or missing drops the row."""
    n = F.col(weight).cast("int")
    out = df.where(n > 0).withColumn("__i", F.explode(F.sequence(F.lit(1), n))).drop(weight)
    return out.withColumnRenamed("__i", index) if index else out.drop("__i")


def cross_with(df: DataFrame, **vectors: Sequence) -> DataFrame:
    """Every row with every combination of literal vectors (distinct, sorted): a narrow explode."""
    for name, values in vectors.items():
        levels = F.array(*[F.lit(v) for v in sorted(set(values))])
        df = df.withColumn(name, F.explode(levels))
    return df


def pair_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of one table with every row of the other, where that is what is asked for.

    Both sides are dealt over a square of cells of about ``PAIRS_PER_CELL`` results and meet in an
    equi-join on the cell, so no side is gathered or broadcast whole and each task makes a bounded share.
    """
    n, m = left.count(), right.count()
    side = max(1, math.ceil(math.sqrt(n * m / PAIRS_PER_CELL)))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(side)).cast("int")
        return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(side - 1))))

    return dealt(left, "__i", "__j").join(dealt(right, "__j", "__i"), ["__i", "__j"]).drop("__i", "__j")


def key_frame(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every combination of the distinct values of the keys; a missing value is a value too.

    The input is read once, for the combinations that occur; the values of each key and their counts come from those.
    """
    seen = df.select(*keys).distinct()
    if len(keys) == 1:
        return seen
    seen = cut_lineage(seen)
    frame = seen.select(keys[0]).distinct()
    for k in keys[1:]:
        frame = pair_all(frame, seen.select(k).distinct())
    return frame


def complete(df: DataFrame, keys: Sequence[str], fill: Mapping[str, object] | None = None) -> DataFrame:
    """Add the missing key combinations; new rows hold missing values or the given fill."""
    out = null_safe_join(key_frame(df, keys), df, keys, "left")
    for c, v in (fill or {}).items():
        out = out.withColumn(c, F.coalesce(c, F.lit(v)))
    return out


def date_frame(df: DataFrame, keys: Sequence[str], day: str, step: str = "1 day") -> DataFrame:
    """Every distinct key with every day from the first to the last of the whole table."""
    span = df.agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi")).alias("s")).scalar()
    return (df.select(*keys).distinct().withColumn("__s", span)
            .withColumn(day, F.explode(F.sequence(F.col("__s.lo"), F.col("__s.hi"),
                                                  F.expr(f"interval {step}"))))
            .drop("__s"))


def value_range(df: DataFrame, column: str, n: int) -> Column:
    """``n`` evenly spaced values from the smallest to the largest, as an array."""
    lo_hi = df.agg(F.struct(F.min(column).cast("double").alias("lo"),
                            F.max(column).cast("double").alias("hi")).alias("s"))
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return lo_hi.select(F.transform(
        steps, lambda i: F.col("s.lo") + (F.col("s.hi") - F.col("s.lo")) * i / F.lit(float(n - 1))
    ).alias("a")).scalar()


def grid(df: DataFrame, by: Sequence[str], ranges: Mapping[str, int] | None = None,
         values: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Prediction grid: distinct values of ``by``, evenly spaced ranges and given values, crossed."""
    out = key_frame(df, by)
    for c, n in (ranges or {}).items():
        out = out.withColumn(c, F.explode(value_range(df, c, n)))
    return cross_with(out, **(values or {}))


def fill_ids(df: DataFrame, column: str, identity: Sequence[str], prefix: str = "ran") -> DataFrame:
    """Give each row without an id a repeatable one of its own.

    The id is the whole hash of the columns that identify a row and the number of the row among those
    alike. A narrow count of the hashes tells which rows are the only ones of their kind; those get number 1 without a shuffle.
    Rows alike in every column are counted first, so a frequent row is one group row, and their
    numbers are interchangeable; rows that are alike in ``identity`` only follow the hash of the whole row.
    """
    text = paste(*[F.col(f"`{c}`").cast("string") for c in identity], sep="|")
    kind = F.when(F.col(column).isNull(), F.xxhash64(text))
    repeated = cut_lineage(df.where(F.col(column).isNull()).groupBy(kind.alias("__kind")).agg(F.count(F.lit(1)).alias("n"))
                           .where("n > 1").select("__kind"))
    marked = df.withColumn("__kind", kind)
    alone = null_safe_join(marked, repeated, ["__kind"], "left_anti").drop("__kind")
    alone = alone.withColumn(column, F.coalesce(F.col(column).cast("string"), F.concat(F.lit(prefix), F.md5(text), F.lit("_1"))))
    if repeated.isEmpty():
        return alone
    return alone.unionByName(_number_alike(null_safe_join(marked, repeated, ["__kind"], "left_semi").drop("__kind"), column, F.md5(text), prefix))


def _number_alike(df: DataFrame, column: str, identity: Column, prefix: str) -> DataFrame:
    whole = F.md5(paste(*[F.col(f"`{c}`").cast("string") for c in df.columns], sep="|"))
    alike = cut_lineage(df.withColumns({"__id": identity, "__row": whole}).groupBy(*[f"`{c}`" for c in df.columns], "__id", "__row").agg(
        F.count(F.lit(1)).alias("__n")))
    # The order is that of the row hash; its first 13 digits (52 bits) cut evenly are chunks along it, as many as the rows need.
    place = F.conv(F.substring("__row", 1, 13), 16, 10).cast("bigint")
    chunked = alike.withColumn("__h", F.floor(place / (2**52 // even_chunks(alike) + 1)))
    counted = running_sum(chunked, ["__id"], ["__h", "__row"], {"__upto": F.col("__n")}, F.col("__h"))
    made = F.concat(F.lit(prefix), F.col("__id"), F.lit("_"), F.col("__k").cast("string"))
    filled = counted.withColumn("__k", F.explode(F.sequence(F.col("__upto") - F.col("__n") + 1, F.col("__upto"))))
    return filled.withColumn(column, made).select(*[f"`{c}`" for c in df.columns])


def hash_bucket(df: DataFrame, identity: Sequence[str], n: int) -> Column:
    """An even spread of the rows over ``n`` buckets that depends on their identity only."""
    return F.pmod(hash32(*[F.col(c) for c in identity]), F.lit(n)).cast("int")
