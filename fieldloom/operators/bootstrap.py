"""Trait imputation along a scale hierarchy and the weighted bootstrap of trait moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import paste
from ..functions.uniform import uniform
from ..session import cut_lineage
from .joins import null_safe_join, with_group_stats
from .ordered import hashed_order, row_index, running_sum
from .stats import moments

#: Classes of the hash that comes first in the order of rows. Fixed: a larger table must not change the order of the rows it shares.
HASH_CLASSES = 16
#: Weights relative to the largest of their group: steps of 1e-20, sums up to 10^18 times the largest.
WEIGHT_TYPE = "decimal(38,20)"


def trait_fill(cover: DataFrame, traits: DataFrame, hierarchy: Sequence[str], taxon: str = "species",
               trait: str = "trait", value: str = "value", min_n: int = 2) -> DataFrame:
    """For each taxon of a plot and each trait: the finest scale with enough values.

    ``hierarchy`` runs from coarse to fine; level 0 is the whole table. A level serves when it has
    ``min_n`` values, or all values there are. Result: the cover rows with ``trait``, ``level``,
    ``n_sample`` and the mean of the values at that level. The values themselves are not multiplied
    with the plots; ``bootstrap_draws`` picks them by number.
    """
    known = traits.where(F.col(value).isNotNull())
    places = cover.select(*hierarchy, taxon).distinct()
    chosen = null_safe_join(places, _level_sizes(known, [], taxon, trait, value, 0), [taxon], "inner")
    for level in range(1, len(hierarchy) + 1):
        at = list(hierarchy[:level])
        chosen = null_safe_join(chosen, _level_sizes(known, at, taxon, trait, value, level),
                                [*at, taxon, trait], "left")
    levels = list(range(len(hierarchy), -1, -1))

    def serves(level: int) -> Column:
        n = F.col(f"__n{level}")
        return F.lit(True) if level == 0 else (n >= min_n) | (n == F.col("__n0"))

    def pick(cells: str) -> Column:
        return F.coalesce(*[F.when(serves(lv), F.col(f"{cells}{lv}")) for lv in levels])

    chosen = chosen.select(
        *hierarchy, taxon, trait,
        F.coalesce(*[F.when(serves(lv), F.lit(lv)) for lv in levels]).alias("level"),
        pick("__n").alias("n_sample"), pick("__m").alias("mean_value"))
    return null_safe_join(cover, chosen, [*hierarchy, taxon], "inner")


def _level_sizes(known, at, taxon, trait, value, level):
    return known.groupBy(*at, taxon, trait).agg(
        F.count(F.lit(1)).alias(f"__n{level}"), F.avg(value).alias(f"__m{level}"))


def bootstrap_draws(filled: DataFrame, traits: DataFrame, groups: Sequence[str], hierarchy: Sequence[str],
                    row_id: Sequence[str], trait_id: Sequence[str], weight: str = "cover", taxon: str = "species",
                    trait: str = "trait", value: str = "value", n_rep: int = 100, sample_size: int = 200,
                    seed: int = 1525, chunks: int = HASH_CLASSES) -> DataFrame:
    """Weighted draws with replacement: ``n_rep`` replicates of ``sample_size`` values per group.

    A draw first picks a cover row with probability proportional to its weight, then one of the
    trait values of the scale chosen for that row. ``row_id`` and ``trait_id`` identify a cover row
    and a trait value; they fix the order, so a repeated task gives the same draws.
    """
    traits = cut_lineage(traits)
    picked = weighted_pick(filled, groups, row_id, weight, [*hierarchy, taxon, trait, "level", "n_sample"],
                           n_rep, sample_size, seed, chunks)
    label = paste(*[F.col(g) for g in groups], sep="|")
    number = F.floor(uniform(F.lit(seed + 1), label, F.col("replicate"), F.col("draw")) * F.col("n_sample")) + 1
    picked = cut_lineage(picked.withColumn("__number", number))
    known = traits.where(F.col(value).isNotNull())
    spread = hashed_order(known, trait_id, chunks)
    keep = [*groups, "replicate", "draw"]
    parts = None
    for level in range(len(hierarchy) + 1):
        at = [*hierarchy[:level], taxon, trait]
        numbered = row_index(spread, ["__h", *trait_id], at, "__number", F.col("__part"))
        part = null_safe_join(picked.where(F.col("level") == level),
                              numbered.select(*at, "__number", F.col(value).alias("__value")),
                              [*at, "__number"], "inner").select(*keep, F.col("__value").alias("value"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def weighted_pick(rows: DataFrame, groups: Sequence[str], row_id: Sequence[str], weight: str, keep: Sequence[str],
                  n_rep: int, sample_size: int, seed: int, chunks: int = HASH_CLASSES) -> DataFrame:
    """Rows picked with replacement, with probability proportional to their weight in the group.

    The rows of a group lie side by side on a line, each as long as its weight, in an order that
    hashing spreads over classes. A draw is a point on the line. Points and rows meet by cell: the
    line has as many cells as draws and a row covers the cells it touches, so this is an equi-join
    on (group, cell) and a large group is spread over all its cells.
    """
    cells = n_rep * sample_size
    kept = [c for c in dict.fromkeys(keep) if c not in groups]
    ids = [c for c in row_id if c not in groups and c not in kept]
    # Weights relative to the largest of the group: exact sums whatever their unit.
    weighted = with_group_stats(rows.select(*groups, *kept, *ids, F.col(weight).cast("double").alias("__v")).where("__v > 0"), groups,
                                {"__top": F.max("__v")})
    work = cut_lineage(weighted.withColumn("__w", (F.col("__v") / F.col("__top")).cast(WEIGHT_TYPE)).drop("__v", "__top"))
    within = [c for c in row_id if c not in groups]
    spread = hashed_order(work, row_id, chunks, within)
    line = running_sum(spread, groups, ["__h", *within], {"__end": F.col("__w")}, F.col("__part"))
    sizes = work.groupBy(*groups).agg(F.sum("__w").alias("__total"))
    line = null_safe_join(line, sizes, groups, "left")
    total = F.col("__total").cast("double")
    line = line.withColumns({
        "__a": (F.col("__end") - F.col("__w")).cast("double") / total,
        "__b": F.when(F.col("__end") == F.col("__total"), F.lit(1.0)).otherwise(
            F.col("__end").cast("double") / total)})
    first = F.floor(F.col("__a") * cells)
    last = F.least(F.floor(F.col("__b") * cells), F.lit(cells - 1))
    pieces = line.select(*groups, *kept, "__a", "__b", F.explode(F.sequence(first, last)).alias("__cell"))
    label = paste(*[F.col(g) for g in groups], sep="|")
    points = (work.select(*groups).distinct()
              .withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n_rep))))
              .withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(sample_size))))
              .withColumn("__u", uniform(F.lit(seed), label, F.col("replicate"), F.col("draw"))))
    points = points.withColumn("__cell", F.floor(F.col("__u") * cells))
    hit = null_safe_join(points, pieces, [*groups, "__cell"], "inner")
    return hit.where((F.col("__a") <= F.col("__u")) & (F.col("__u") < F.col("__b"))).select(
        *groups, "replicate", "draw", *kept)


def bootstrap_moments(draws: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean, variance, skewness and kurtosis of every replicate."""
    return moments(draws, [*groups, "replicate"], "value")


def summarise_moments(replicates: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean of each moment over the replicates, with one standard deviation below and above."""
    aggs = []
    for m in ("mean", "var", "skew", "kurt"):
        aggs += [F.avg(m).alias(m), (F.avg(m) - F.stddev_samp(m)).alias(f"ci_low_{m}"),
                 (F.avg(m) + F.stddev_samp(m)).alias(f"ci_high_{m}")]
    return replicates.groupBy(*groups).agg(*aggs)
