"""Order-dependent operators that never need a whole group in one task.

A window over a group puts the group in one task, which fails when one group holds a third of
the rows. Here every group is cut into chunks that follow the row order. Each chunk is one window
partition, and a carry row hands the state at the end of a chunk to the next chunk of the group.
The carries are one row per (group, chunk), so the only window over a whole group runs on those.

A chunk is a number that never decreases along the row order. By default it comes from quantiles of
the order column; where any order will do, callers pass an even hash of the row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.nulls import ColumnLike, as_col
from ..functions.uniform import hash32
from ..session import cut_lineage
from .joins import null_safe_join

CUTS = 127
SLICES = 32
ROWS_PER_CHUNK = 200_000
TEXT_CELLS = 16_384
TEXT_BROADCAST = 200_000
AHEAD = tuple(1 << i for i in range(11))  # how far a common beginning is looked for at once


def even_chunks(df: DataFrame) -> int:
    """How many chunks a table needs so that each stays small, from its number of rows."""
    return max(16, math.ceil(df.count() / ROWS_PER_CHUNK))


def hashed_order(df: DataFrame, ids: Sequence[str], classes: int, within: Sequence[str] | None = None) -> DataFrame:
    """Add a hash class ``__h`` of the ids and ``__part``, a chunk number for the order (``__h``, *``within``).

    ``within`` (default: the ids) orders the rows of a class. The order depends on the rows only, not on their number: a table
    too large for one chunk a class is cut further along ``within``.
    """
    spread = df.withColumn("__h", F.pmod(hash32(*[F.col(c) for c in ids]), F.lit(classes)))
    inside = list(ids if within is None else within)
    if not inside or df.count() <= classes * ROWS_PER_CHUNK:
        return spread.withColumn("__part", F.col("__h"))
    beyond = 1 << 56  # more than any chunk number along the columns
    return add_chunks(spread, inside, out="__fine").withColumn("__part", F.col("__h") * beyond + F.col("__fine")).drop("__fine")


def order_number(df: DataFrame, column: str) -> Column | None:
    """A number or time column as a double that keeps its order; None for other columns."""
    kind, c = df.schema[column].dataType.typeName(), F.col(f"`{column}`")
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind == "timestamp":
        return F.unix_micros(c).cast("double")
    if kind == "timestamp_ntz":
        return (F.unix_date(c.cast("date")) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("double")
    if kind in ("string", "boolean", "binary"):
        return None
    return c.cast("double")


def add_chunks(df: DataFrame, order: Sequence[str], chunk: Column | None = None, out: str = "__chunk") -> DataFrame:
    """Add the chunk number for an ascending order of the given columns.

    Without an expression: a number or time column is cut at quantiles over the whole table, each interval into
    even slices, more of them the more rows there are; a text column is cut into ranges of prefixes by their counts
    (``text_chunks``). A value so frequent that it fills a chunk by itself is cut along the second order column, and so are
    missing values, which come first. The cut points are read once and written into the plan or a table, so all branches of an
    operator and every retry of a task see the same chunks.
    """
    if chunk is not None:
        return df.withColumn(out, chunk)
    x = order_number(df, order[0])
    tie = order_number(df, order[1]) if len(order) > 1 else None
    if x is None or (tie is None and len(order) > 1):
        return _mixed_chunks(df, order, out)
    probe = df.select(x.alias("x"), *([tie.alias("t")] if tie is not None else []))
    places = [i / CUTS for i in range(CUTS + 1)]
    *found, rows = probe.agg(*[F.percentile_approx(c, places, 8 * CUTS) for c in probe.columns], F.count(F.lit(1))).first()
    found = [[p for p in points or [] if math.isfinite(p)] for points in found]  # infinite values need no cut
    slices = max(SLICES, math.ceil(rows / (CUTS * ROWS_PER_CHUNK)))  # more rows, more slices of each interval
    points = found[0] or [0.0]
    work = _slice(df.withColumn("__x", x), "__x", sorted(set(points)), out, slices)
    if tie is None:
        return work.withColumn(out, F.coalesce(out, F.lit(-1))).drop("__x")
    heavy = sorted({p for p in points if points.count(p) > 1})
    work = _slice(work.withColumn("__t", tie), "__t", sorted(set(found[1] or [0.0])), "__along", slices)
    split = F.col("__x").isNull() | (F.col("__x").isin(heavy) if heavy else F.lit(False))
    last = (CUTS + 3) * slices
    along = F.when(split, F.coalesce("__along", F.lit(-1))).otherwise(last)
    return work.withColumn(out, F.coalesce(out, F.lit(-1)) * (last + 2) + along).drop("__x", "__t", "__along")


def _mixed_chunks(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Chunks where the first or the second order column is a text."""
    x = order_number(df, order[0])
    if x is None:
        work = text_chunks(df, order[0], out)
        heavy = F.col(out) % 2 == 1
    else:
        places = [i / CUTS for i in range(CUTS + 1)]
        points, rows = df.agg(F.percentile_approx(x, places, 8 * CUTS), F.count(F.lit(1))).first()
        points = [p for p in points or [] if math.isfinite(p)] or [0.0]
        slices = max(SLICES, math.ceil(rows / (CUTS * ROWS_PER_CHUNK)))
        work = _slice(df.withColumn("__x", x), "__x", sorted(set(points)), out, slices)
        often = sorted({p for p in points if points.count(p) > 1})
        heavy = F.col("__x").isin(often) if often else F.lit(False)
        work = work.withColumn(out, F.coalesce(F.when(F.col("__x").isNotNull(), F.col(out)), F.lit(-1)).cast("bigint"))
    if len(order) == 1:
        return work.drop("__x")
    work = work.withColumn("__heavy", F.coalesce(heavy, F.lit(False)) | (F.col(out) < 0)).drop("__x")
    along = add_chunks(work, [order[1]], out="__along")
    last = 1 << 32  # beyond any chunk along one column
    return along.withColumn(out, F.col(out) * (last + 2) + F.when(F.col("__heavy"), F.col("__along")).otherwise(last)).drop("__heavy", "__along")


def text_chunks(df: DataFrame, column: str, out: str = "__chunk") -> DataFrame:
    """Add chunk numbers that follow the order of a text column: ranges of prefixes, each with a bounded number of rows.

    Prefixes are counted level by level. One with too many rows is replaced by the longer prefixes behind the part that all its rows
    share, so a long common beginning costs one level; a single value with too many rows has a chunk of its own, an
    odd number. At most ``TEXT_CELLS`` prefixes are split on a level (each holds more than its share of the rows), which bounds
    the tables that are joined to the rows; no row is shuffled for its prefix. Neighbouring prefixes with few rows share a chunk.
    Missing values have chunk -1.
    """
    kind = df.schema[column].dataType.typeName()
    x = F.hex(f"`{column}`") if kind == "binary" else F.col(f"`{column}`").cast("string")
    present = df.select(x.alias("x")).where("x IS NOT NULL")
    limit = max(ROWS_PER_CHUNK, math.ceil(present.count() / TEXT_CELLS))
    frontier = present.select("x", F.substring("x", 1, 1).alias("cell"), F.lit(1).alias("taken"))
    splits, cells = [], None
    while True:
        edges = [f(F.xxhash64(F.substring("x", F.lit(1), F.col("taken") + step))).alias(f"{n}{step}") for step in AHEAD for f, n in ((F.min, "lo"), (F.max, "hi"))]
        counted = cut_lineage(frontier.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("taken").alias("taken"), (F.min(F.xxhash64("x")) == F.max(F.xxhash64("x"))).alias("single"), *edges))
        crowded = (F.col("n") > limit) & ~F.col("single")
        level = counted.where(~crowded).select("cell", "n", (F.col("n") > limit).alias("hot"))
        cells = level if cells is None else cells.unionByName(level)
        shared = F.greatest(F.lit(0), *[F.when(F.col(f"lo{s}") == F.col(f"hi{s}"), s) for s in AHEAD])
        split = counted.where(crowded).select("cell", (F.col("taken") + shared + 1).alias("taken"))
        if split.isEmpty():
            break
        splits.append(split)
        frontier = frontier.drop("taken").join(F.broadcast(split), "cell").select("x", F.substring("x", F.lit(1), F.col("taken")).alias("cell"), "taken")
    before = F.coalesce(F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per prefix
    numbers = cut_lineage(cells.select(F.col("cell").alias("__cell"), (F.floor(before / limit) * 2 + F.col("hot").cast("bigint")).alias(out)))
    work = df.withColumn("__cell", F.substring(x, 1, 1))
    for split in splits:
        longer = F.broadcast(split.select(F.col("cell").alias("__cell"), F.col("taken").alias("__taken")))
        work = work.join(longer, "__cell", "left").withColumn("__cell", F.when(F.col("__taken").isNull(), F.col("__cell")).otherwise(
            F.substring(x, F.lit(1), F.col("__taken")))).drop("__taken")
    few = numbers.limit(TEXT_BROADCAST + 1).count() <= TEXT_BROADCAST
    work = work.join(F.broadcast(numbers) if few else numbers, "__cell", "left")
    return work.select(*df.columns, F.coalesce(out, F.lit(-1).cast("bigint")).alias(out))


def _slice(df: DataFrame, column: str, cuts: Sequence[float], out: str, slices: int) -> DataFrame:
    """Add the number of the interval between cut points, times ``slices``, plus the slice in it."""
    edges = [float("-inf"), *cuts, float("inf")]
    found = Bucketizer(splits=edges, inputCol=column, outputCol="__b", handleInvalid="keep").transform(df)
    bucket = F.col("__b").cast("int")
    # Start and inverse width of every interval; the open ones at both ends are not sliced.
    starts = [0.0, *cuts]
    scales = [0.0, *[slices / (hi - lo) for lo, hi in zip(cuts, cuts[1:])], 0.0]
    lo, scale = F.get(_doubles(starts), bucket), F.get(_doubles(scales), bucket)
    part = F.when(F.abs(column) < float("inf"), F.least(F.lit(slices - 1), F.floor((F.col(column) - lo) * scale)).cast("int"))
    return found.withColumn(out, bucket.cast("long") * slices + F.coalesce(part, F.lit(0))).drop("__b")


def _doubles(values: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{v!r}D" for v in values) + ")")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: dict[str, ColumnLike],
                chunk: Column | None = None) -> DataFrame:
    """Add running sums ``{new: measure}`` per group, in the given total order."""
    work = add_chunks(df.withColumns({f"__m_{n}": as_col(c) for n, c in measures.items()}), order, chunk)
    names = list(measures)
    totals = work.groupBy(*keys, "__chunk").agg(*[F.sum(f"__m_{n}").alias(f"__m_{n}") for n in names])
    by_chunk = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carries = totals.select(*keys, "__chunk", F.lit(0).alias("__row"),
                            *[F.sum(f"__m_{n}").over(by_chunk).alias(f"__m_{n}") for n in names])
    both = work.withColumn("__row", F.lit(1)).unionByName(carries, allowMissingColumns=True)
    along = (W.partitionBy(*keys, "__chunk").orderBy("__row", *order)
             .rowsBetween(W.unboundedPreceding, W.currentRow))
    out = both.withColumns({n: F.sum(f"__m_{n}").over(along) for n in names})
    return out.where("__row = 1").select(*df.columns, *names)


def row_index(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), out: str = "row_index",
              chunk: Column | None = None) -> DataFrame:
    """Row number (from 1) in a total order, over the whole table or per group."""
    if keys:
        return running_sum(df, keys, order, {out: F.lit(1).cast("long")}, chunk)
    single = df.withColumn("__all", F.lit(0))
    return running_sum(single, ["__all"], order, {out: F.lit(1).cast("long")}, chunk).drop("__all")


def sort_position(df: DataFrame, column: str, tie: str, out: str = "position") -> DataFrame:
    """Position of each row in ascending order, missing values last, ties by a unique column."""
    # Known values first: a flag in front of the order, and a chunk of its own per flag.
    flagged = add_chunks(df.withColumn("__missing", F.col(column).isNull().cast("int")), [column, tie], out="__c")
    chunk = F.col("__c") + F.col("__missing") * F.lit(1 << 40)
    return row_index(flagged, ["__missing", column, tie], out=out, chunk=chunk).drop("__missing", "__c")


def rank_table(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Position of each row of a table with one row per level, missing values first."""
    return row_index(df, order, out=out)


def lag_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str],
                 chunk: Column | None = None) -> DataFrame:
    """Add the values ``{new: column}`` of the row before, per group in the given total order."""
    work = add_chunks(df, order, chunk)
    state = F.struct(*[F.col(c).alias(f"__c_{n}") for n, c in columns.items()])
    ends = work.groupBy(*keys, "__chunk").agg(
        F.max_by(state, F.struct(*order)).alias("__state"))
    nxt = F.lead("__chunk").over(W.partitionBy(*keys).orderBy("__chunk"))
    carries = ends.select(*keys, nxt.alias("__chunk"), "__state.*", F.lit(0).alias("__row")).where(
        F.col("__chunk").isNotNull())
    rows = work.withColumns({f"__c_{n}": F.col(c) for n, c in columns.items()}).withColumn("__row", F.lit(1))
    both = rows.unionByName(carries, allowMissingColumns=True)
    along = W.partitionBy(*keys, "__chunk").orderBy("__row", *order)
    out = both.withColumns({n: F.lag(f"__c_{n}").over(along) for n in columns})
    return out.where("__row = 1").select(*df.columns, *columns)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group in the given total order, as a partial aggregate."""
    return _edge_row(df, keys, order, F.min_by)


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each group in the given total order, as a partial aggregate."""
    return _edge_row(df, keys, order, F.max_by)


def _edge_row(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        pick(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def first_value(column: ColumnLike, order: Sequence[str], skip_missing: bool = False) -> Column:
    """Aggregate: value of the first row in the order, or of the first row that has one."""
    c = as_col(column)
    key = F.struct(*order)
    return F.min_by(c, F.when(c.isNotNull(), key) if skip_missing else key)


def last_value(column: ColumnLike, order: Sequence[str], skip_missing: bool = False) -> Column:
    """Aggregate: value of the last row in the order, or of the last row that has one."""
    c = as_col(column)
    key = F.struct(*order)
    return F.max_by(c, F.when(c.isNotNull(), key) if skip_missing else key)


def value_counts_cumulative(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group and distinct value: its count ``n``, the counts below and up to it, and the group size.

    Missing values are left out. Counting first shrinks the rows to distinct values before any
    ordering takes place.
    """
    present = df.where(F.col(value).isNotNull())
    counts = cut_lineage(present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    grouped = list(keys) or ["__all"]
    counts = counts if keys else counts.withColumn("__all", F.lit(0))
    out = running_sum(counts, grouped, [value], {"n_upto": F.col("n")})
    sizes = counts.groupBy(*grouped).agg(F.sum("n").alias("n_total"))
    out = null_safe_join(out, sizes, grouped, "left")
    return out.drop("__all").withColumn("n_below", F.col("n_upto") - F.col("n"))


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Empirical distribution function: one row per group and distinct value."""
    counted = value_counts_cumulative(df, keys, value)
    return counted.withColumn("ecdf", F.col("n_upto") / F.col("n_total")).select(
        *keys, value, "n", "ecdf")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics), long: prob, quantile.

    Only the two order statistics around each probability leave the running counts, so no group
    is gathered in one task.
    """
    counted = value_counts_cumulative(df, keys, value)
    counted = counted if keys else counted.withColumn("__all", F.lit(0))
    by = list(keys) or ["__all"]

    def meets(p: Column) -> Column:
        place = (F.col("n_total") - 1) * p
        return (F.col("n_below") <= F.ceil(place)) & (F.floor(place) < F.col("n_upto"))

    # Only the probabilities that fall on a value leave its row.
    rows = counted.withColumn("prob", F.explode(F.filter(F.array(*[F.lit(float(p)) for p in probs]), meets)))
    at = (F.col("n_total") - 1) * F.col("prob")
    lo, hi = F.floor(at), F.ceil(at)
    holds_lo = (F.col("n_below") <= lo) & (lo < F.col("n_upto"))
    holds_hi = (F.col("n_below") <= hi) & (hi < F.col("n_upto"))
    picked = rows.where(holds_lo | holds_hi).groupBy(*by, "prob").agg(
        F.max(F.when(holds_lo, F.col(value))).alias("a"),
        F.max(F.when(holds_hi, F.col(value))).alias("b"),
        F.max(at - lo).alias("w"))
    return picked.select(*keys, "prob", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + F.col("w") * (F.col("b") - F.col("a"))).alias("quantile"))
