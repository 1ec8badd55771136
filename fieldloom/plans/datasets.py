"""The named datasets, from raw tables to the tables that analyses start from.

Each is a function of DataFrames; ``fieldloom.sources.tables.materialise`` turns one into a stored
table when several others build on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.aggregate import bind_rows, keep_groups
from ..operators.census import clean_coded, clean_rounds, prepare_rounds
from ..operators.columns import rename, zscore
from ..operators.community import add_site_context, impute_groups, impute_moss_height, impute_totals, raw_plot_groups, species_rows
from ..operators.joins import map_keys, natural_join, null_safe_join, with_group_stats
from ..operators.ordered import first_value, last_value
from ..operators.survival import LAST_CENSUSES, event_rows, survival_rows
from ..session import cut_lineage


def community(raw: DataFrame, normals: DataFrame, key_map: DataFrame | None = None) -> DataFrame:
    """Cleaned species cover with imputed moss heights and totals; only the narrow ``raw_plot_groups`` are written."""
    rows = species_rows(raw.withColumn("__plot", F.col("plotID")), normals, key_map)
    return impute_groups(rows, raw_plot_groups(raw, normals, key_map))


def community_plots(raw: DataFrame, normals: DataFrame, key_map: DataFrame | None = None) -> DataFrame:
    """``community`` without its species rows, for tables of plots: imputed heights and totals by plot, year and functional group."""
    groups = raw_plot_groups(raw, normals, key_map)
    return impute_totals(impute_moss_height(groups, groups), groups).drop("__rows", "__plot")


def rounds_recruits(raw: DataFrame, normals: DataFrame, key_map: DataFrame | None = None, **options) -> DataFrame:
    """Recruits of the numbered census in bare and control plots."""
    rows = prepare_rounds(raw, **options)
    if key_map is not None:
        rows = map_keys(rows, key_map, ["plotID", "blockID"])
    cleaned = clean_rounds(add_site_context(rows, normals))
    plots = cleaned.where(F.col("fg_removed").isin("FGB", "C"))
    plots = plots.withColumn("fg_removed", F.when(F.col("fg_removed") == "FGB", "Gap").otherwise("Intact"))
    plot = F.when(F.col("turfID").isNotNull(), F.concat("blockID", F.lit("RTC"))).otherwise(F.col("plotID"))
    return plots.withColumn("plotID", plot).drop("comment", "functional_group")


def coded_recruits(raw: DataFrame, normals: DataFrame, id_column: str = "ID") -> DataFrame:
    """Recruits of the coded census with their site context."""
    return rename(add_site_context(clean_coded(raw, id_column), normals), seedID="ID")


def combined_recruits(coded: DataFrame, rounds: DataFrame, drought: DataFrame,
                      order: Sequence[str] = ("plotID", "seedID")) -> DataFrame:
    """Recruits of both studies on one table, with the plot total of the season and the climate.

    A missing month is July in early seasons and otherwise the first, then the last known month of
    the site, season and year, in the given order.
    """
    # The studies share no seedling, so their full join is a union. Three aggregates read it: written once. What is joined to it is
    # written too: known to be small, it shuffles no row.
    rows = cut_lineage(bind_rows(coded, rounds))
    rows = with_group_stats(rows, ["siteID", "blockID", "plotID", "season", "year"], {"plot_count": F.sum("count")}, written=True)
    rows = rows.withColumn("count", F.col("plot_count")).drop("plot_count")
    rows = fill_month(rows, ["siteID", "season", "year"], order, written=True)
    climate = cut_lineage(drought.drop("season", "date"))
    return rename(null_safe_join(rows.drop("date"), climate, ["siteID", "year", "month"], "left"),
                  treatment="fg_removed")


def fill_month(df: DataFrame, keys: Sequence[str], order: Sequence[str], season: str = "season",
               month: str = "month", early_month: int = 7, written: bool = False) -> DataFrame:
    early = df.withColumn(month, F.when(F.col(season) == "early", F.lit(early_month)).otherwise(F.col(month)))
    # Rows without a month set no edge, and groups of early rows need none.
    known = early.where(F.col(month).isNotNull())
    known = known.where(F.col(season).isNull() | (F.col(season) != "early")) if season in keys else known
    edges = with_group_stats(early, keys, {"__first": first_value(month, order, skip_missing=True),
                                           "__last": last_value(month, order, skip_missing=True)}, source=known, written=written)
    return edges.withColumn(month, F.coalesce(month, "__first", "__last")).drop("__first", "__last")


def plot_season_totals(recruits: DataFrame) -> DataFrame:
    """One row per plot and season instead of the total repeated on every seedling."""
    return recruits.select("siteID", "blockID", "plotID", "season", "year", "month", "treatment", "count").distinct()


def scaled_recruits(df: DataFrame) -> DataFrame:
    """Standardised climate columns and the squared drought index."""
    out = zscore(df, {"temperature_scaled": "temperature", "precipitation_scaled": "precipitation",
                      "spei_scaled": "spei"})
    return out.withColumn("spei_sq", F.col("spei_scaled") * F.col("spei_scaled"))


def analysis_table(counts: DataFrame, drought: DataFrame, weather: DataFrame, center: Mapping[str, str],
                   divisors: Mapping[str, float] | None = None, max_count: int = 190,
                   first_year: int = 2008) -> DataFrame:
    """Distinct counts with climate, extreme counts cut, covariates centred and a year index."""
    rows = natural_join(natural_join(counts.distinct(), drought.drop("season")), weather)
    rows = zscore(rows.where(F.col("sumcount") < max_count), center, center_only=True, divisors=divisors)
    return rows.withColumn("year1", F.col("year") - first_year)


def group_subset(df: DataFrame, plot_keys: Sequence[str], value: str, unit: float, keep: Column,
                 out: str = "annual_count") -> DataFrame:
    """Annual count per plot on every row, rescaled, for the rows of one analysis."""
    counted = with_group_stats(df, plot_keys, {out: F.sum(value)})
    return counted.withColumn(f"{out}_scaled", F.col(out) / F.lit(unit)).where(keep)


def plot_frame(records: DataFrame, frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the records joined in full to a plot by round frame."""
    return natural_join(records.select(*keys).distinct(), frame, "outer")


def abundance(records: DataFrame, frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts for every row of the frame; plots without records have missing counts."""
    return natural_join(records.select(*columns).distinct(), frame, "right")


def plots_with_records(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Drop plots in which nothing was ever found."""
    return keep_groups(df, keys, F.sum(value) >= 1)


def survival_dataset(studies: Mapping[str, DataFrame], ids: Sequence[str], climate: DataFrame, last: Sequence[str] = LAST_CENSUSES) -> DataFrame:
    """Rows per individual and census of all studies, with study, censor class, duration and climate.

    Each study holds long histories with the ids, siteID, date and count; ids are unique over the studies.
    """
    rows = None
    for name, history in studies.items():
        part = history.withColumn("study", F.lit(name))
        rows = part if rows is None else bind_rows(rows, part)
    return survival_rows(rows, ids, climate, last)


def survival_events(rows: DataFrame, ids: Sequence[str], covariates: Sequence[str], last: Sequence[str] = LAST_CENSUSES) -> DataFrame:
    """First and last occurrence of each individual of ``survival_dataset`` with the months to its events."""
    return event_rows(rows, ids, covariates, "date", "count", last)
