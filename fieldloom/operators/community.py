"""Plot communities, cover, biomass and traits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lookups import (PRECIPITATION_LEVEL_SITES, REMAINING_GROUPS, TEMPERATURE_LEVELS,
                                 TEMPERATURE_LEVEL_SITES, TRAIT_CLASSES, TRAIT_CLASS_LEVELS,
                                 TRAIT_LABELS, TRAIT_LABEL_LEVELS, TRAIT_LEVELS, TRAIT_NAMES,
                                 level_order, lookup, recode)
from ..functions.nulls import is_in, not_in, sum_strict, weighted_mean
from ..functions.text import replace_first
from ..session import cut_lineage
from .aggregate import drop_duplicates_missing, drop_known_bad, first_within
from .columns import cols_between, rename
from .joins import assert_unique, fill_from_group, map_keys, natural_join, null_safe_join, with_group_stats
from .reshape import to_long
from .stats import origin_slope

COVER_TOTALS = ("total_graminoids", "total_forbs", "total_bryophytes")
COVER_KEYS = ("year", "plotID", "functional_group")
PLOT_KEYS = ("year", "siteID", "blockID", "plotID", "removal", "fg_removed")

# Cells corrected by hand (plot and species to the two cover totals).
COVER_CORRECTIONS = [
    ("Fau1C", "Hol.lan", 70.0, 70.0),
    ("Fau2C", "Hol.lan", 60.0, 25.0),
    ("Ram5C", "Fes.viv", 50.0, 40.0),
    ("Vik5C", "Hol.lan", 45.0, 60.0),
]
# Blocks corrected by hand.
BLOCK_CORRECTIONS = {
    "Fau1XC": "Fau1", "Fau4XC": "Fau4", "Fau3XC": "Fau5", "Gud1XC": "Gud12", "Gud4XC": "Gud15",
    "Ves4C": "Ves4",
}
SINGLE_SPECIES = ("Dan.dec", "Ver.ver")
# Functional groups that remain where a total of that group can be imputed.
WITH_GRAMINOIDS = ("G", "GB", "GF", "FGB")
WITH_FORBS = ("F", "FB", "GF", "FGB")
PLOT_AREA = 0.0625


def temperature_level(site: str = "siteID") -> Column:
    chain = F.when(F.lit(False), "")
    for level, sites in TEMPERATURE_LEVEL_SITES.items():
        chain = chain.when(F.col(site).isin(list(sites)), level)
    return chain.otherwise("boreal")


def precipitation_level(site: str = "siteID") -> Column:
    chain = F.when(F.lit(False), 0)
    for level, sites in PRECIPITATION_LEVEL_SITES.items():
        chain = chain.when(F.col(site).isin(list(sites)), level)
    return chain.otherwise(4)


def add_site_context(df: DataFrame, normals: DataFrame, fix_treatment: bool = True) -> DataFrame:
    """Temperature and precipitation level, site normals, and the groups left by the treatment.

    ``normals`` has one row per site; a repeated site is an error. The treatment column becomes ``fg_removed``.
    """
    out = df.withColumns({"temperature_level": temperature_level(), "precipitation_level": precipitation_level()})
    # Written, so that the planner knows how few sites there are and shuffles no row for them.
    out = null_safe_join(out, cut_lineage(assert_unique(normals, ["siteID"])), ["siteID"], "left")
    if not fix_treatment:
        return out
    return rename(out.withColumn("fg_remaining", lookup("treatment", REMAINING_GROUPS)), fg_removed="treatment")


def clean_biomass(raw: DataFrame, normals: DataFrame, order: Sequence[str],
                  key_map: DataFrame | None = None) -> DataFrame:
    """Removed biomass: duplicates of one site-year dropped, plot codes repaired, context added.

    ``order`` decides which of the duplicates is first.
    """
    scope = (F.col("siteID") == "Ovstedalen") & (F.col("year") == 2018)
    one = first_within(raw, scope, ["plotID", "removed_fg"], order)
    plot = F.when((F.col("treatment") == "GF") & F.col("plotID").contains("FG"),
                  replace_first("plotID", "FG", "GF")).otherwise(F.col("plotID"))
    fixed = one.withColumn("plotID", plot)
    if key_map is not None:
        fixed = map_keys(fixed, key_map, ["plotID", "blockID"])
    return add_site_context(fixed, normals)


def control_biomass(biomass: DataFrame) -> DataFrame:
    """Standing biomass of the extra control plots."""
    return rename(biomass.where(F.col("fg_removed") == "XC"), standing_biomass="biomass")


def clean_community(raw: DataFrame, normals: DataFrame, key_map: DataFrame | None = None) -> DataFrame:
    """Species cover per plot and year with corrected cells, cover sums and imputed moss height."""
    return impute_moss_height(corrected_community(raw, normals, key_map))


def corrected_community(raw: DataFrame, normals: DataFrame, key_map: DataFrame | None = None) -> DataFrame:
    """``clean_community`` before the imputation: narrow steps and joins."""
    rows = with_group_stats(_corrected_cells(raw), list(COVER_KEYS), {"sum_cover": sum_strict("cover")})
    return _placed(rows, normals, key_map)


def species_rows(raw: DataFrame, normals: DataFrame, key_map: DataFrame | None = None) -> DataFrame:
    """``corrected_community`` without the cover sums, for tables that need none: no row is shuffled."""
    return _placed(_corrected_cells(raw), normals, key_map)


def _corrected_cells(raw: DataFrame) -> DataFrame:
    rows = raw.withColumn("blockID", F.coalesce(lookup("plotID", BLOCK_CORRECTIONS), F.col("blockID")))
    rows = rows.where(not_in("species", SINGLE_SPECIES))
    grams, forbs = F.col("total_graminoids"), F.col("total_forbs")
    for plot, species, g, f in COVER_CORRECTIONS:
        here = (F.col("plotID") == plot) & (F.col("species") == species)
        grams = F.when(F.col("total_graminoids").isNull() & here, g).otherwise(grams)
        forbs = F.when(F.col("total_forbs").isNull() & here, f).otherwise(forbs)
    return rows.withColumns({"total_graminoids": grams, "total_forbs": forbs}).withColumn(
        "moss_height", F.when(F.col("moss_height").isNull() & (F.col("total_bryophytes") <= 5), 0.0)
        .otherwise(F.col("moss_height")))


def _known_bad() -> Column:
    return (F.col("plotID") == "Alr3C") & F.col("turfID").isNull()


def _placed(rows: DataFrame, normals: DataFrame, key_map: DataFrame | None) -> DataFrame:
    rows = drop_known_bad(rows, _known_bad())
    if key_map is not None:
        rows = map_keys(rows, key_map, ["plotID", "blockID"])
    return add_site_context(rows, normals).drop("sumcover")


def plot_groups(rows: DataFrame) -> DataFrame:
    """The distinct plot values and cover sums of corrected rows, with their number of rows: written once, narrow.

    There is a row per plot, year and functional group, not per species. Heights, slopes and plot-level tables need no more.
    """
    names = [*cols_between(rows, "year", "fg_removed"), "fg_remaining", "vegetation_height", *COVER_TOTALS]
    return cut_lineage(rows.groupBy(*names, "moss_height", "functional_group", "sum_cover").agg(F.count(F.lit(1)).alias("__rows")))


def raw_plot_groups(raw: DataFrame, normals: DataFrame, key_map: DataFrame | None = None) -> DataFrame:
    """``plot_groups`` of the corrected rows in one aggregate of the raw ones, with ``__plot``, the plot before it is mapped.

    Covers are summed with the groups and put together on those, so the sums are never joined to species rows.
    """
    rows = _corrected_cells(raw)
    plain = [*cols_between(rows, "year", "treatment"), "vegetation_height", *COVER_TOTALS, "moss_height", "functional_group"]
    bad = F.coalesce(_known_bad(), F.lit(True)).alias("__bad")
    groups = cut_lineage(rows.groupBy(*plain, bad).agg(
        F.count(F.lit(1)).alias("__rows"), F.count("cover").alias("__known"), F.sum("cover").alias("__cover")))
    total = F.when(F.sum("__known") < F.sum("__rows"), None).otherwise(F.sum("__cover"))
    groups = with_group_stats(groups, list(COVER_KEYS), {"sum_cover": total}).where(~F.col("__bad"))
    groups = groups.withColumn("__plot", F.col("plotID"))
    if key_map is not None:
        groups = map_keys(groups, key_map, ["plotID", "blockID"])
    groups = add_site_context(groups, normals)
    names = [*cols_between(groups, "year", "fg_removed"), "fg_remaining", "vegetation_height", *COVER_TOTALS]
    return cut_lineage(groups.groupBy(*names, "moss_height", "functional_group", "sum_cover", "__plot").agg(F.sum("__rows").alias("__rows")))


def impute_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Cover sums, heights and totals of ``raw_plot_groups`` on species rows that have ``__plot``, by one join.

    Equal to ``impute_totals`` of ``impute_moss_height`` of the corrected rows.
    """
    changed = ("total_graminoids", "total_forbs", "moss_height")
    kept = groups.withColumns({f"__was_{c}": F.col(c) for c in changed})
    filled = impute_totals(impute_moss_height(kept, groups), groups)
    # The plot first: rows are sorted by the keys in this order.
    same = ["plotID", "year", "functional_group", "__plot"]
    same += [c for c in (*cols_between(groups, "year", "fg_removed"), "fg_remaining", "vegetation_height", "total_bryophytes") if c not in same]
    new = filled.select(*same, *[F.col(f"__was_{c}").alias(c) for c in changed], *[F.col(c).alias(f"__new_{c}") for c in changed],
                        "sum_cover", "imputed_height")
    out = null_safe_join(rows, new, [*same, *changed], "left")
    context = rows.columns.index("temperature_level")
    order = [*rows.columns[:context], "sum_cover", *rows.columns[context:], "imputed_height"]
    return out.select(*[F.col(f"__new_{c}").alias(c) if c in changed else F.col(f"`{c}`") for c in order if c != "__plot"])


def impute_moss_height(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Missing moss height from the mean of the control plot, then of the site and year.

    Heights belong to plots, so they are filled on the distinct plot rows (of ``groups``, the ``plot_groups`` of the rows)
    and joined back to the rows once. ``imputed_height`` says whether the height equals the site-year mean;
    missing when unknown.
    """
    groups = plot_groups(rows) if groups is None else groups
    names = [*cols_between(groups, "year", "fg_removed"), "fg_remaining", "vegetation_height", *COVER_TOTALS]
    plots = groups.select(*names, "moss_height").distinct().withColumn("__was", F.col("moss_height"))
    control = F.col("fg_removed") == "C"
    once = fill_from_group(plots, "moss_height", ["plotID"], names, where=control, apply_to=control)
    twice = fill_from_group(once, "moss_height", ["siteID", "year"], names, mean_column="__site")
    filled = twice.select(*names, F.col("__was").alias("moss_height"), F.col("moss_height").alias("__new"),
                          (F.col("moss_height") == F.col("__site")).alias("imputed_height"))
    out = null_safe_join(rows, filled, [*names, "moss_height"], "left")
    return out.withColumn("moss_height", F.col("__new")).drop("__new")


def impute_totals(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Missing totals of a functional group as slope times the sum of its covers.

    The slope is a regression through the origin over the rows that have both; with ``groups``, the ``plot_groups`` of the rows, each of
    those counts as many times as it has rows.
    """
    graminoid = is_in("fg_remaining", WITH_GRAMINOIDS) & (F.col("functional_group") == "graminoid")
    forb = is_in("fg_remaining", WITH_FORBS) & (F.col("functional_group") == "forb")
    weight = F.lit(1) if groups is None else F.col("__rows")

    def slope(here: Column, total: str) -> Column:
        x, y = F.when(here & F.col(total).isNotNull(), F.col("sum_cover")), F.col(total)
        return F.try_divide(F.sum(weight * x * y), F.sum(weight * x * x))

    slopes = (rows if groups is None else groups).agg(F.struct(
        slope(graminoid, "total_graminoids").alias("g"), slope(forb, "total_forbs").alias("f")).alias("s")).scalar()

    def filled(total, here, slope):
        return F.when(F.col(total).isNull() & here, F.col("sum_cover") * slope).otherwise(F.col(total))

    return rows.withColumn("__s", slopes).withColumns({
        "total_graminoids": filled("total_graminoids", graminoid, F.col("__s.g")),
        "total_forbs": filled("total_forbs", forb, F.col("__s.f")),
    }).drop("__s")


def cover_rows(community: DataFrame) -> DataFrame:
    """Species cover without the extra control plots."""
    names = [*cols_between(community, "year", "fg_removed"), "species", "cover", "functional_group",
             *cols_between(community, "temperature_level", "fg_remaining")]
    return community.where(F.col("fg_removed") != "XC").select(*names)


def plot_cover(community: DataFrame) -> DataFrame:
    """Plot-level heights and totals, one row per plot and year."""
    names = [*cols_between(community, "year", "fg_removed"), "vegetation_height", "moss_height", *COVER_TOTALS]
    plots = community.where(F.col("fg_removed") != "XC").select(*names).distinct()
    once = drop_duplicates_missing(plots, PLOT_KEYS, "total_graminoids")
    return drop_known_bad(once, (F.col("year") == 2019) & (F.col("plotID") == "Alr3C")
                          & (F.col("total_bryophytes") == 2))


def cover_height(community: DataFrame) -> DataFrame:
    """Plot level, long by functional group: total cover, height and their product."""
    names = [*cols_between(community, "year", "fg_removed"), "fg_remaining", "vegetation_height",
             "moss_height", *COVER_TOTALS]
    plots = community.select(*names).distinct()
    once = drop_duplicates_missing(plots, PLOT_KEYS, "total_graminoids")
    for year, height in ((2016, 80), (2017, 83)):
        once = drop_known_bad(once, (F.col("plotID") == "Alr3C") & (F.col("year") == year)
                              & (F.col("vegetation_height") > height))
    groups = F.array(
        F.struct(F.lit("graminoids").alias("g"), F.col("vegetation_height").alias("h"),
                 F.col("total_graminoids").alias("t")),
        F.struct(F.lit("bryophytes").alias("g"), F.lit(None).cast("double").alias("h"),
                 F.col("total_bryophytes").alias("t")),
        F.struct(F.lit("forbs").alias("g"), F.col("vegetation_height").alias("h"),
                 F.col("total_forbs").alias("t")))
    long = once.withColumn("__g", F.explode(groups))
    kept = [c for c in once.columns if c not in ("vegetation_height", "total_graminoids",
                                                 "total_forbs", "total_bryophytes", "blockID")]
    return long.select(*kept, F.col("__g.g").alias("functional_group"),
                       F.col("__g.h").alias("height"), F.col("__g.t").alias("total"))


def merge_biomass(community: DataFrame, standing: DataFrame) -> DataFrame:
    """Plot cover by functional group with standing biomass in g per square metre."""
    group = F.when((F.col("plotID") == "Hog1XC") & (F.col("standing_biomass") == 29.44), "graminoids").otherwise(
        F.col("functional_group"))
    biomass = standing.where(F.col("functional_group").isin("graminoids", "forb", "bryophytes")).select(
        "siteID", "plotID", recode(group, {"forb": "forbs"}).alias("functional_group"),
        (F.col("standing_biomass") / PLOT_AREA).alias("standing_biomass"))
    joined = natural_join(cover_height(community), biomass)
    height = F.when(F.col("functional_group") == "bryophytes", F.col("moss_height")).otherwise(F.col("height"))
    return joined.withColumn("cover_height", F.col("total") * height)


def biomass_coefficients(merged: DataFrame) -> DataFrame:
    """Standing biomass predicted from cover by a slope per functional group.

    Bryophytes use cover times height, the others cover; the slope is applied to the predictor it
    was fitted on.
    """
    predictor = F.when(F.col("functional_group") == "bryophytes", F.col("cover_height")).otherwise(F.col("total"))
    work = merged.withColumn("__x", predictor)
    slopes = work.groupBy("functional_group").agg(
        origin_slope(F.col("__x"), F.col("standing_biomass")).alias("__slope"))
    out = null_safe_join(work.where(F.col("fg_removed") != "XC"), slopes, ["functional_group"], "left")
    return out.withColumn("standing_biomass_calculated", F.col("__x") * F.col("__slope")).drop("__x", "__slope")


def community_weighted(cover: DataFrame, traits: DataFrame, keys: Sequence[str], value: str = "value",
                       weight: str = "cover", out: str = "weighted") -> DataFrame:
    """Cover-weighted mean of a trait per plot and group."""
    return natural_join(cover, traits).groupBy(*keys).agg(weighted_mean(value, weight).alias(out))


def describe_traits(df: DataFrame, trait: str = "trait_trans") -> DataFrame:
    """Names, plot labels, display order and class of traits."""
    kind = F.when(F.lit(False), "")
    for name, members in TRAIT_CLASSES.items():
        kind = kind.when(F.col(trait).isin(list(members)), name)
    label = lookup(trait, TRAIT_LABELS)
    out = df.withColumns({
        "trait_fancy": recode(trait, TRAIT_NAMES),
        "figure_names": F.when(label.isin(list(TRAIT_LABEL_LEVELS)), label),
        "figure_order": level_order(label, TRAIT_LABEL_LEVELS),
        "trait_order": level_order(trait, TRAIT_LEVELS),
        "class": kind.otherwise("Leaf economics"),
    })
    return out.withColumn("class_order", level_order("class", TRAIT_CLASS_LEVELS))


def trait_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Measures side by side to one row per trait."""
    return to_long(df, columns, "trait", "value", drop_missing=True)
