"""Presence histories of individuals over repeated censuses.

A history is one row per individual with one column per census, in census order. The number of
censuses is small and fixed, so a history is built by one aggregate and repaired by expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import parse_day_month_year, year_of_code
from ..functions.lookups import (CONTROL_TURFS, GRAMINOID_CODES, GRAMINOID_PATTERN, PRESENCE_CODES,
                                 PRESENCE_NOTES, ROMAN_BLOCKS, SITE_SPELLINGS, SITES,
                                 SPECIES_SPELLINGS, control_turf_table, lookup, recode, site_table)
from ..functions.nulls import (ColumnLike, as_col, first_present, if_else, is_in, matches,
                               not_in, paste, row_sum, to_number)
from ..functions.text import replace_all, replace_first, strip, substr
from ..session import cut_lineage
from .aggregate import bind_rows
from .columns import cols_between
from .joins import lookup_join, null_safe_join
from .reshape import cross_with, fill_ids, repeat_rows, to_long_by_pattern, to_wide

# The labels of the censuses.
ROUND_CODES = {1: "spr_18", 2: "aut_18", 3: "spr_19", 4: "aut_19"}
SIX_CENSUSES = ("aut_09", "spr_10", "aut_10", "spr_11", "aut_11", "spr_12")


# --- histories ---------------------------------------------------------------------------
#
# The repairs look at neighbouring censuses. Written column by column, every step would repeat the
# steps before it and the plan would grow exponentially, so a history is held as one text with a
# character per census, and a repair is one pattern.


def history_text(censuses: Sequence[str], counts: bool = False) -> Column:
    """A character per census: the code, or with ``counts`` 1 for present and 0 for absent.

    ``-`` stands for a missing census, ``x`` for a count that is neither 0 nor 1.
    """
    def mark(name: str) -> Column:
        c = F.col(f"`{name}`")
        if counts:
            return F.when(c == 1, "1").when(c == 0, "0").when(c.isNotNull(), "x").otherwise("-")
        return F.coalesce(F.substring(c, 1, 1), F.lit("-"))

    return F.concat(*[mark(c) for c in censuses])


def resurrect_text(text: ColumnLike, missing: str = "0", seen: str = "S", later: str = "TD") -> Column:
    """A missing census right before a lost or dead code becomes seen; the first one stays.

    A repaired census is neither missing nor lost, so no repair depends on another one.
    """
    return F.regexp_replace(as_col(text), f"(?<=.){missing}(?=[{later}])", seen)


def gap_fill_text(text: ColumnLike, two_gap: bool = True) -> Column:
    """Fill an absence between two presences: first 1 0 any 1, then 1 0 1.

    Filling from left to right gives the same: a census that needs its filled predecessor has a
    presence right after it, so the second pattern fills it.
    """
    filled = F.regexp_replace(as_col(text), "(?<=1)0(?=.1)", "1") if two_gap else as_col(text)
    return F.regexp_replace(filled, "(?<=1)0(?=1)", "1")


def first_seen(text: ColumnLike, labels: Sequence[str]) -> Column:
    """Label of the first presence when every census before it is an absence, else missing."""
    lead = F.regexp_extract(as_col(text), "^(0*)[1x]", 0)
    return F.get(F.array(*[F.lit(lb) for lb in labels]), F.when(lead != "", F.length(lead) - 1))


def first_occurrence(censuses: Sequence[str], labels: Sequence[str] | None = None) -> Column:
    """Label of the first census with a count when every census before was zero.

    A missing count before the first one leaves the result missing.
    """
    return first_seen(history_text(censuses, counts=True), list(labels or censuses))


def first_occurrence_long(df: DataFrame, keys: Sequence[str], census: str, present: ColumnLike) -> DataFrame:
    """First census with presence and number of censuses with presence, from long rows."""
    seen = as_col(present) > 0
    return df.groupBy(*keys).agg(F.min(F.when(seen, F.col(census))).alias("first_census"),
                                 F.count_if(seen).alias("n_seen"))


def resurrect(df: DataFrame, censuses: Sequence[str], missing: str = "0", seen: str = "S",
              later: str = "TD") -> DataFrame:
    """``resurrect_text`` on a column of one-letter codes per census."""
    work = df.withColumn("__h", resurrect_text(history_text(censuses), missing, seen, later))
    return work.withColumns({c: F.when(F.col(f"`{c}`").isNotNull(), F.substring("__h", i, 1))
                             for i, c in enumerate(censuses, start=1)}).drop("__h")


def gap_fill(df: DataFrame, censuses: Sequence[str], two_gap: bool = True) -> DataFrame:
    """``gap_fill_text`` on a column of counts per census; other counts than 0 and 1 stay."""
    work = df.withColumn("__h", gap_fill_text(history_text(censuses, counts=True), two_gap))
    return work.withColumns({c: F.when(F.substring("__h", i, 1) == "1", F.lit(1).cast(df.schema[c].dataType))
                             .otherwise(F.col(f"`{c}`")) for i, c in enumerate(censuses, start=1)}).drop("__h")


def presence_code(c: ColumnLike) -> Column:
    """First letter of a presence code, in one spelling per meaning."""
    return recode(substr(c, 1, 1), PRESENCE_CODES)


def presence_number(c: ColumnLike) -> Column:
    """Noted presence as a number; notes for not found, and nothing at all, are zero."""
    return to_number(F.coalesce(recode(c, PRESENCE_NOTES), F.lit("0")))


def history(df: DataFrame, keys: Sequence[str], census: str, value: str, censuses: Sequence,
            on_duplicate: str = "error") -> DataFrame:
    """Long census rows to one row per individual."""
    return to_wide(df, keys, census, value, censuses, on_duplicate=on_duplicate)


# --- species and ids -------------------------------------------------------------------------


def is_graminoid(species: ColumnLike) -> Column:
    return is_in(species, GRAMINOID_CODES) | matches(species, GRAMINOID_PATTERN)


def functional_group(species: ColumnLike) -> Column:
    """Grass-like plants by code; everything else, also a missing species, is a forb."""
    return F.when(is_graminoid(species), "graminoid").otherwise("forb")


def impute_species(df: DataFrame, target: str, others: Sequence[str]) -> DataFrame:
    """Take a missing species from other censuses, in the given order."""
    return df.withColumn(target, first_present([target, *others]))


def treatment_class(plot: ColumnLike) -> Column:
    """Intact for control codes, else Gap for bare codes, else missing (first match wins)."""
    return F.when(matches(plot, "C"), "Intact").when(matches(plot, "FGB"), "Gap")


def with_treatment_class(df: DataFrame, plot: str, out: str = "treatment") -> DataFrame:
    """Class plots by their code and drop plots of other classes."""
    return df.withColumn(out, treatment_class(plot)).where(F.col(out).isNotNull())


# --- numbered census: wide rounds to one row per individual and round --------------------------


def species_of_indicators(df: DataFrame, columns: Sequence[str]) -> Column:
    """Name of the first indicator column that is not empty."""
    return first_present([F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in columns])


def prepare_rounds(raw: DataFrame, first_species: str = "unID", last_species: str = "Viola",
                   identity: Sequence[str] | None = None, expand_round: int = 4, rounds: int = 4) -> DataFrame:
    """Wide numbered-census records to tidy rows, one per seedling and round.

    Cleans site names, drops rows that are not seedlings, gives missing ids, reads species
    indicators, splits rows that stand for several seedlings into one seedling each (seen in
    ``expand_round``), drops plots without any seedling and adds the turf label. ``identity`` names
    the columns that tell rows without an id apart (default: all of them).
    """
    spark = raw.sparkSession
    presences = [f"presence{i}" for i in range(1, rounds + 1)]
    kept = raw.withColumn("site", recode("site", SITE_SPELLINGS)).where(
        F.col("NS").isNull() & not_in("Comment", ["out of plot"])
        & F.coalesce(*[F.col(p).cast("string") for p in presences]).isNotNull())
    found = [presence_number(F.col(f"`{c}`").cast("string")) for c in raw.columns if c[:-1] == "presence" and c[-1:].isdigit()]
    # Plots with a seedling are judged on the records, before ids are given and rows made long, and written: no row is shuffled for them.
    plots = cut_lineage(kept.groupBy("turfID").agg((
        (F.count_if(reduce(or_, [n.isNull() for n in found])) == 0) & (F.sum(reduce(add, found)) >= 1)).alias("__keep")).where("__keep").select("turfID"))
    kept = fill_ids(kept, "seedID", identity or [c for c in kept.columns if c != "seedID"])
    kept = null_safe_join(kept, plots, ["turfID"], "left_semi")
    species = cols_between(raw, first_species, last_species)
    one = kept.select(
        *[F.col(f"`{c}`") for c in kept.columns if c not in species],
        species_of_indicators(kept, species).alias("species"))
    one = one.withColumn("seedID", paste(F.col("seedID"), F.col("turfID"), sep="_"))
    one = one.withColumn("__several", F.coalesce(reduce(or_, [n > 1 for n in found]), F.lit(False)))
    one = one.withColumns({p: F.col(p).cast("string") for p in presences})
    long = to_long_by_pattern(one, [c for c in one.columns if c[-1:].isdigit()],
                              [".value", "round"], r"(.*)(\d)$")
    long = long.withColumns({
        "date": parse_day_month_year(if_else(F.col("date") == "8/82019", F.lit("8/8/2019"), F.col("date"))),
        "year": F.when(F.col("round").isin("1", "2"), 2018).otherwise(2019),
        "round": F.col("round").cast("int"),
        "presence": presence_number("presence"),
        "species": recode(replace_first("species", "_", "."), SPECIES_SPELLINGS),
    })
    tidy = long.select(
        "year", "date", F.col("site").alias("siteID"), "blockID", F.col("turfID").alias("plotID"),
        "treatment", "seedID", "round", "species", "presence", "x", "y",
        F.col("Obs").alias("recorder"), F.col("Comment").alias("comment"), "__several")
    tidy = cut_lineage(tidy)  # read three times below

    # Records that stand for several seedlings go with all their rows. Only where another record has the same id, or an id looks
    # like that of a split seedling, rows elsewhere go with them.
    split_id = F.col("seedID").rlike(r"^s\d+\.\d+_")
    beyond = cut_lineage(tidy.groupBy("seedID").agg(F.max("__several").alias("any"), F.min("__several").alias("all"))
                         .where(F.col("any") & (~F.col("all") | split_id)).select("seedID"))
    several = tidy.where(F.col("presence") > 1).drop("__several")
    named = [c for c in several.columns if c != "presence"]
    copies = repeat_rows(several, "presence", index="copy")
    # A split seedling is named by its record, round and copy, which needs no numbering of the table.
    split = cross_with(
        copies.withColumn("seedID", paste(F.lit("s"), F.col("round"), F.lit("."), F.col("copy"), F.lit("_"), F.col("seedID")))
        .drop("round", "copy"), round=list(range(1, rounds + 1)))
    split = split.withColumn("presence", F.when(F.col("round") == expand_round, 1.0).otherwise(0.0))

    together = bind_rows(tidy.where(~F.col("__several") & (F.col("presence") < 2)).drop("__several"), split.select(*named, "presence"))
    together = null_safe_join(together, beyond, ["seedID"], "left_anti")
    turfs = control_turf_table(spark).withColumnRenamed("TTtreat", "turfID")
    together = lookup_join(together, turfs, ["plotID"], CONTROL_TURFS)
    number_y = to_number(F.when(F.col("y") == "205/105", "205").otherwise(F.col("y")))
    return together.withColumns({
        "blockID": paste(substr("siteID", 1, 3), F.col("blockID")),
        "functional_group": F.lit("forb"),
        "y": number_y,
    }).withColumn("comment", if_else(
        (F.col("x") > 250) | (F.col("y") > 250), F.lit("coordinate outside plot"), F.col("comment"),
    )).where(F.col("seedID").isNotNull())


def plot_round_frame(community: DataFrame, drop_treatment: str = "XC") -> DataFrame:
    """Every plot with every census round."""
    plots = community.where(F.col("fg_removed") != drop_treatment).select(
        "siteID", "blockID", "plotID", "fg_removed").distinct()
    frame = cross_with(plots, year=[2018, 2019], half=[0, 1])
    return frame.withColumn("round", ((F.col("year") - 2018) * 2 + F.col("half") + 1).cast("int")).drop("half")


def clean_rounds(data: DataFrame) -> DataFrame:
    """One row per seedling with its first occurrence, survival duration, species and date.

    Seedlings never seen drop out. A frame of all plots and rounds would add plots without any
    seedling only, which have nothing to describe, so none is joined.

    One aggregate makes a row of a seedling's rounds with their dates. Species and dates belong to an id, so only ids with
    several such rows (other comments, species, ...) need joins; those are few, if any.
    """
    everything = data.withColumn("presence", F.coalesce("presence", F.lit(0.0)))
    dropped = ("x", "y", "species", "recorder", "date", "year", "round", "presence")
    ids = [c for c in everything.columns if c not in dropped]
    names = [str(r) for r in ROUND_CODES]
    # Day and year of each round next to its presence, in the same aggregate.
    dated = {f"__{c}{n}": F.max(F.when(F.col("round").eqNullSafe(F.lit(n)), F.col(c))) for n in ROUND_CODES for c in ("date", "year")}
    one = cut_lineage(to_wide(everything, [*ids, "species"], "round", "presence", list(ROUND_CODES), more=dated))
    shared = cut_lineage(one.groupBy("seedID").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seedID"))
    alone = _described(null_safe_join(one, shared, ["seedID"], "left_anti"), names)
    seen = F.col("first_occurrence")
    out = alone.withColumns({c: reduce(lambda rest, n: F.when(seen == ROUND_CODES[n], F.col(f"__{c}{n}")).otherwise(rest),
                                       ROUND_CODES, F.lit(None).cast(data.schema[c].dataType)) for c in ("date", "year")})
    out = out.select(*ids, "first_occurrence", "survival_duration", "count", "species", "date", "year")
    if not shared.isEmpty():
        out = out.unionByName(_shared_ids(null_safe_join(everything, shared, ["seedID"], "left_semi"), ids, names))
    return out.withColumns({
        "month": F.month("date"),
        "season": F.when(matches("first_occurrence", "spr"), "early").otherwise("late"),
    })


def _described(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    return wide.withColumns({
        "first_occurrence": first_occurrence(names, list(ROUND_CODES.values())),
        "survival_duration": row_sum([f"`{n}`" for n in names]),
        "count": F.lit(1.0),
    }).where(F.col("first_occurrence").isNotNull())


def _shared_ids(data: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``clean_rounds`` of ids with several rows: every species and date of an id goes to each of them."""
    wide = _described(to_wide(data, ids, "round", "presence", list(ROUND_CODES)), names)
    species = data.select("seedID", "species").distinct()
    dates = data.select("date", "year", "seedID", lookup("round", ROUND_CODES).alias("first_occurrence")).distinct()
    out = null_safe_join(wide, species, ["seedID"], "left")
    return null_safe_join(out, dates, ["seedID", "first_occurrence"], "left").drop(*names)


# --- coded census: six censuses in columns ----------------------------------------------------


def clean_coded(raw: DataFrame, id_column: str = "ID") -> DataFrame:
    """Six coded censuses to one row per seedling with first occurrence, duration and date.

    ``raw`` is the all-text table; ``id_column`` names the column that holds the seedling id.
    """
    spark = raw.sparkSession
    site = (F.when(matches("Site", "vs"), "Ovs").when(matches("Site", "^L"), "Lav")
            .when(matches("Site", "lr"), "Alr").when(matches("Site", "g"), "Hog").otherwise(F.col("Site")))
    rows = raw.where(is_in("Treat", ["RTG", "RTC"])).withColumn("Site", strip(site))
    rows = impute_species(rows, "Species_11_2", ["Species_11_1", "Species_10_2_2", "Species_09_2"])
    rows = rows.withColumns({
        "C_11_1": F.when(F.col("C_11_1").isNull() & F.col("Species_11_1").isNotNull(), "S")
        .otherwise(F.col("C_11_1")),
        "C_11_2": F.when(F.col("Rec_11_2").isNotNull() & F.col("C_11_2").isNull()
                         & F.col("C_12_1").isNotNull(), "S").otherwise(F.col("C_11_2")),
    })
    source = dict(zip(SIX_CENSUSES, ("C_09_2", "C_10_1", "C_10_2", "C_11_1", "C_11_2", "C_12_1")))
    named = rows.select(
        F.col("Site").alias("code"), F.col("Treat").alias("removal_code"),
        lookup("Block", ROMAN_BLOCKS).alias("block"), F.col(f"`{id_column}`").alias("ID"),
        F.col("Species_11_2").alias("species"), *[F.col(v).alias(k) for k, v in source.items()])
    sites = site_table(spark).select("old", F.col("new").alias("siteID"))
    placed = lookup_join(named, sites, {"code": "old"}, SITES)
    placed = placed.withColumn("blockID", paste(F.col("code"), F.col("block"))).withColumn(
        "plotID", paste(F.col("blockID"), F.col("removal_code")))
    placed = placed.withColumns({
        "treatment": F.when(F.col("removal_code") == "RTG", "Gap").otherwise("Intact"),
        "species": replace_all(strip("species"), " ", "."),
    })
    placed = placed.withColumn("functional_group", functional_group("species")).where(
        F.col("functional_group") != "graminoid")
    placed = placed.withColumn("species", replace_all(replace_all("species", ".cf", ""), ".CF", ""))
    placed = cut_lineage(placed)  # read three times for the ids
    placed = fill_ids(placed, "ID", ["plotID", "species", *SIX_CENSUSES], prefix="ran-")

    ids = ["siteID", "blockID", "plotID", "treatment", "ID", "species"]
    # Several records of one id are one seedling: the record whose codes sort last counts.
    marks = F.concat(*[F.substring(F.coalesce(presence_code(c), F.lit("0")), 1, 1) for c in SIX_CENSUSES])
    coded = placed.select(*ids, marks.alias("__codes")).groupBy(*ids).agg(F.max("__codes").alias("__codes"))
    codes = resurrect_text("__codes")
    seen = gap_fill_text(F.translate(F.regexp_replace(codes, "[^S]", "0"), "S", "1"))
    found = coded.withColumn("__h", seen).where(F.col("__h").contains("1")).withColumns({
        "first_occurrence": first_seen("__h", SIX_CENSUSES),
        "count": F.lit(1.0),
        "survival_duration": F.length(F.replace("__h", F.lit("0"), F.lit(""))).cast("double"),
    })
    season = F.when(F.col("first_occurrence").startswith("aut"), "late").otherwise("early")
    return found.withColumns({"year": year_of_code("first_occurrence"), "season": season}).withColumn(
        "date", F.make_date("year", F.when(F.col("season") == "late", 9).otherwise(7), F.lit(1))
    ).withColumn("month", F.month("date")).select(
        *ids, "season", "count", "survival_duration", "first_occurrence",
        "year", "date", "month")


# --- counts and dates --------------------------------------------------------------------------


def census_dates(raw: DataFrame, rounds: int = 4) -> DataFrame:
    """Latest census date per site and round, from wide text dates."""
    long = to_long_by_pattern(raw.select("siteID", *[f"date{i}" for i in range(1, rounds + 1)]),
                              [f"date{i}" for i in range(1, rounds + 1)],
                              ["category", "season"], r"(^.{0,8})([1-9])", values_to="date")
    text = F.when(F.col("date") == "8/82019", "08/08/2019").otherwise(
        replace_all("date", r"\.", "/"))
    parsed = long.withColumn("date", parse_day_month_year(text)).where(F.col("date").isNotNull())
    return parsed.groupBy("siteID", F.col("season").cast("int").alias("round")).agg(
        F.max("date").alias("date")).select(
        "siteID", lookup("round", ROUND_CODES).alias("season"), "date")


def complete_counts(counts: DataFrame, frame: DataFrame, keys: Sequence[str], value: str,
                    out: str = "sumcount") -> DataFrame:
    """Sum of counts per key over a complete frame; keys without rows count zero.

    Counts are summed before the join, so the join sees one row per key.
    """
    sums = counts.groupBy(*keys).agg(F.sum(F.coalesce(value, F.lit(0))).alias(out))
    joined = null_safe_join(frame.select(*keys).distinct(), sums, keys, "outer")
    return joined.withColumn(out, F.coalesce(out, F.lit(0)))


def coded_frame(plots: DataFrame, keys: Sequence[str] = ("siteID", "blockID", "plotID", "treatment")) -> DataFrame:
    """Every plot with every coded census of 2009 (late) to 2012 (early)."""
    frame = cross_with(plots.select(*keys).distinct(), year=[2009, 2010, 2011, 2012], season=["early", "late"])
    return frame.where(~((F.col("year") == 2009) & (F.col("season") == "early"))
                       & ~((F.col("year") == 2012) & (F.col("season") == "late")))
