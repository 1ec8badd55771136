"""Fixed lookup tables of the field sites and the species, code and trait vocabularies.

Every value here is a fixed value that results depend on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .nulls import ColumnLike, as_col

# Site codes and names, one row per field site
# (code, upper code, lower code, older name, name in use).
SITES = [
    ("Arh", "ARH", "arh", "Arhelleren", "Arhelleren"),
    ("Ovs", "OVS", "ovs", "Ovstedal", "Ovstedalen"),
    ("Ves", "VES", "ves", "Veskre", "Veskre"),
    ("Skj", "SKJ", "skj", "Skjellingahaugen", "Skjelingahaugen"),
    ("Lav", "LAV", "lav", "Lavisdalen", "Lavisdalen"),
    ("Gud", "GUD", "gud", "Gudmedalen", "Gudmedalen"),
    ("Ulv", "ULV", "ulv", "Ulvhaugen", "Ulvehaugen"),
    ("Vik", "VIK", "vik", "Vikesland", "Vikesland"),
    ("Hog", "HOG", "hog", "Hogsete", "Hogsete"),
    ("Alr", "ALR", "alr", "Alrust", "Alrust"),
    ("Fau", "FAU", "fau", "Fauske", "Fauske"),
    ("Ram", "RAM", "ram", "Rambera", "Rambera"),
]
SITE_SCHEMA = "old string, v2 string, v3 string, old2 string, new string"

# Turf labels of the control plots.
CONTROL_TURFS = [
    ("51 TTC", "Fau1C"), ("57 TTC", "Fau2C"), ("68 TTC", "Fau4C"), ("73 TTC", "Fau5C"),
    ("29 TTC", "Alr1C"), ("31 TTC", "Alr2C"), ("37 TTC", "Alr3C"),
    ("134 TTC", "Vik2C"), ("140 TTC", "Vik3C"), ("141 TTC", "Vik4C"), ("146 TTC", "Vik5C"),
    ("101 TTC", "Hog1C"), ("110 TTC", "Hog2C"), ("115 TTC", "Hog3C"),
    ("286 TTC", "Ovs1C"), ("291 TTC", "Ovs2C"), ("297 TTC", "Ovs3C"),
    ("211 TTC", "Arh1C"), ("222 TTC", "Arh3C"), ("226 TTC", "Arh4C"),
    ("263 TTC", "Ves1C"), ("281 TTC", "Ves4C"), ("194 TTC", "Ram4C"), ("198 TTC", "Ram5C"),
    ("6 TTC", "Ulv2C"), ("11 TTC", "Ulv3C"),
    ("236 TTC", "Skj1C"), ("243 TTC", "Skj2C"), ("246 TTC", "Skj3C"), ("251 TTC", "Skj4C"),
    ("511 TTC", "Gud12C"),
]
CONTROL_TURF_SCHEMA = "TTtreat string, plotID string"

# Spellings brought to the name in use.
SITE_SPELLINGS = {
    "Ovstedal": "Ovstedalen",
    "Skjellingahaugen": "Skjelingahaugen",
    "Ulvhaugen": "Ulvehaugen",
}
# Names at the start of logger file names, as one spelling per site.
SITE_SPELLINGS_OF_FILES = {
    "ITAS": "Ulvehaugen",
    "Skjellingavatnet": "Skjelingahaugen",
    "Skjeldingahaugen": "Skjelingahaugen",
    "Skjellingahaugen": "Skjelingahaugen",
    "Ulvhaugen": "Ulvehaugen",
}

# Temperature and precipitation level of the sites.
TEMPERATURE_LEVELS = ("alpine", "sub-alpine", "boreal")
TEMPERATURE_LEVEL_SITES = {
    "alpine": ("Ulvehaugen", "Skjelingahaugen", "Lavisdalen", "Gudmedalen"),
    "sub-alpine": ("Alrust", "Veskre", "Rambera", "Hogsete"),
}
PRECIPITATION_LEVEL_SITES = {
    1: ("Fauske", "Alrust", "Ulvehaugen"),
    2: ("Vikesland", "Hogsete", "Lavisdalen"),
    3: ("Arhelleren", "Rambera", "Gudmedalen"),
}

# Removal treatment to functional groups that remain.
REMAINING_GROUPS = {
    "C": "FGB", "FB": "G", "FGB": "bare", "GB": "F", "F": "GB",
    "GF": "B", "B": "GF", "G": "FB", "XC": "FGB",
}

# Block number of a Roman numeral.
ROMAN_BLOCKS = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5}

# Species codes brought to one form.
SPECIES_SPELLINGS = {
    "Anem.sp": "Ane.sp", "Bellis": "Bel.sp", "Betula": "Bet.sp", "Epil.sp": "Epi.sp",
    "Galium": "Gal.sp", "Hier.sp": "Hie.sp", "Leon.sp": "Leo.sp", "Leuc.sp": "Leu.sp",
    "Oma": "Oma.sp", "Ranu.sp": "Ran.sp", "Rume.sp": "Rum.sp", "Stel.sp": "Ste.sp",
    "Tara.sp": "Tar.sp", "Trif.sp": "Tri.sp", "unID": "NID.seedling", "Veronica": "Ver.sp",
    "Gal sax": "Gal.sax", "Viola": "Vio.sp",
}
# Codes and the pattern that name grass-like plants.
GRAMINOID_CODES = ("G", "Ant.odo", "Ave.fle")
GRAMINOID_PATTERN = "Agr|Car|Des|Fes|Poa|Luz"

# Presence codes of the coded census and of the numbered census.
PRESENCE_CODES = {"s": "S", "H": "S", "?": "T", "C": "S", "E": "S", " ": "S", "1": "S", "V": "S"}
PRESENCE_NOTES = {"NF": "0", "not found": "0", "1?": "1"}
SURVIVAL_CODES = {"dead": 0, "alive": 1, "not found": 0, "1": 1, "dezd": 0}

# Trait codes, the names shown for them, and their plot labels in display order.
TRAIT_NAMES = {
    "height_log": "Height cm", "fresh_mass_log": "Wet mass g", "dry_mass_log": "Dry mass g",
    "leaf_area_log": "Area cm2", "leaf_thickness_log": "Thickness mm", "LDMC": "LDMC g/g",
    "SLA": "SLA cm2/g", "N": "N %", "C": "C %", "CN_ratio": "CN", "d13C": "δC13 ‰",
    "d15N": "δN15 ‰",
}
TRAIT_LABELS = {
    "height_log": "Plant~height~(cm)", "fresh_mass_log": "Leaf~wet~mass~(g)",
    "dry_mass_log": "Leaf~dry~mass~(g)", "leaf_area_log": "Leaf~area~(cm^2)",
    "leaf_thickness_log": "Leaf~thickness~(mm)", "LDMC": "LDMC~(gg^{-1})",
    "SLA": "SLA~(cm^2*g^{-1})", "C": "C~('%')", "N": "N~('%')", "CN_ratio": "CN",
    "d13C": "δ^{13}~C~'(‰)'", "d15N": "δ^{15}~N~'(‰)'",
}
TRAIT_LEVELS = (
    "height_log", "fresh_mass_log", "dry_mass_log", "leaf_area_log", "leaf_thickness_log",
    "LDMC", "SLA", "C", "N", "CN_ratio", "d13C", "d15N",
)
TRAIT_LABEL_LEVELS = (
    "Plant~height~(cm)", "Leaf~dry~mass~(g)", "Leaf~area~(cm^2)", "Leaf~thickness~(mm)",
    "SLA~(cm^2*g^{-1})", "LDMC~(gg^{-1})", "C~('%')", "N~('%')", "CN",
    "δ^{13}~C~'(‰)'", "δ^{15}~N~'(‰)'",
)
TRAIT_CLASSES = {
    "Size": ("height_log", "fresh_mass_log", "dry_mass_log", "leaf_area_log",
             "leaf_thickness_log"),
    "Isotopes": ("d13C", "d15N"),
}
TRAIT_CLASS_LEVELS = ("Size", "Leaf economics", "Isotopes")


def site_table(spark: SparkSession) -> DataFrame:
    return _fixed_table(spark, SITES, SITE_SCHEMA)


def control_turf_table(spark: SparkSession) -> DataFrame:
    return _fixed_table(spark, CONTROL_TURFS, CONTROL_TURF_SCHEMA)


def _fixed_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """The rows as literals of the plan: no list is shipped and no Python task makes them."""
    fields = [f.split() for f in schema.split(", ")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields, strict=True)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def recode(c: ColumnLike, mapping: Mapping) -> Column:
    """Replace listed values; leave the others as they are."""
    c = as_col(c)
    return F.coalesce(lookup(c, mapping), c)


def lookup(c: ColumnLike, mapping: Mapping) -> Column:
    """Value listed for a code; missing when the code is not listed."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), as_col(c))


def level_order(c: ColumnLike, levels) -> Column:
    """Position (from 1) of a value in an ordered list of levels; missing when not listed."""
    return lookup(c, {level: i for i, level in enumerate(levels, start=1)})
