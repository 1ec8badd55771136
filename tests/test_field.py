"""Census, survival, community and dataset operators on hand-built records."""

import datetime as dt
import itertools

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldloom.operators import census, community, survival
from fieldloom.plans import datasets

SIX = list(census.SIX_CENSUSES)


def step_by_step(h, two_gap):
    """The fill rules one census at a time, each seeing the ones before."""
    h = list(h)
    n = len(h)
    if two_gap:
        for i in range(1, n - 2):
            if h[i - 1] == 1 and h[i] == 0 and h[i + 2] == 1:
                h[i] = 1
    for i in range(1, n - 1):
        if h[i - 1] == 1 and h[i] == 0 and h[i + 1] == 1:
            h[i] = 1
    return tuple(h)


@pytest.mark.parametrize("n,two_gap", [(6, True), (6, False), (4, False), (8, True)])
def test_gap_fill_equals_the_step_by_step_rules(spark, n, two_gap):
    names = [f"c{i}" for i in range(n)]
    every = list(itertools.product([0, 1, None], repeat=n)) if n < 8 else list(itertools.product([0, 1], repeat=n))
    data = [(i, *h) for i, h in enumerate(every)]
    df = spark.createDataFrame(data, "id int, " + ", ".join(f"{c} int" for c in names))
    filled = census.gap_fill(df, names, two_gap)
    got = {r.id: tuple(r[c] for c in names) for r in filled.collect()}
    assert got == {i: step_by_step(h, two_gap) for i, h in enumerate(every)}


def test_gap_fill_is_idempotent_without_the_two_gap_rule(spark):
    data = [(i, *h) for i, h in enumerate(itertools.product([0, 1], repeat=6))]
    df = spark.createDataFrame(data, "id int, " + ", ".join(f"{c} int" for c in SIX))
    once = census.gap_fill(df, SIX, two_gap=False)
    assert rows(once) == rows(census.gap_fill(once, SIX, two_gap=False))


def test_resurrect_equals_the_step_by_step_rules(spark):
    every = list(itertools.product(["0", "S", "T", "D"], repeat=5))
    names = SIX[:5]

    def by_hand(h):
        h = list(h)
        for i in range(3, 0, -1):
            if h[i] == "0" and h[i + 1] in ("T", "D"):
                h[i] = "S"
        return tuple(h)

    df = spark.createDataFrame([(i, *h) for i, h in enumerate(every)], "id int, " + ", ".join(f"{c} string" for c in names))
    got = {r.id: tuple(r[c] for c in names) for r in census.resurrect(df, names).collect()}
    assert got == {i: by_hand(h) for i, h in enumerate(every)}


def test_first_occurrence_with_missing_counts(spark):
    data = [(1, 0.0, 2.0, None), (2, None, 1.0, 1.0), (3, 0.0, 0.0, 0.0), (4, 1.0, None, 0.0), (5, 0.0, 0.0, 25.0)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double")
    out = df.withColumn("f", census.first_occurrence(["a", "b", "c"]))
    assert rows(out, "id", "f") == [(1, "b"), (2, None), (3, None), (4, "a"), (5, "c")]


def test_codes(spark):
    df = spark.createDataFrame([(1, "TP", "NF"), (2, "? x", "1?"), (3, None, None), (4, "Vv", "225"), (5, " ", "x")], "id int, c string, p string")
    assert rows(df.select("id", census.presence_code("c").alias("v"))) == [(1, "T"), (2, "T"), (3, None), (4, "S"), (5, "S")]
    assert rows(df.select("id", census.presence_number("p").alias("v"))) == [(1, 0.0), (2, 1.0), (3, 0.0), (4, 225.0), (5, None)]


def test_functional_group_of_missing_species_is_forb(spark):
    df = spark.createDataFrame([(1, None), (2, "Poa.pra"), (3, "G"), (4, "Gal.bor")], "id int, s string")
    assert rows(df.select("id", census.functional_group("s").alias("g"))) == [(1, "forb"), (2, "graminoid"), (3, "graminoid"), (4, "forb")]


def test_treatment_class_takes_the_first_match(spark):
    df = spark.createDataFrame([("Fau1C",), ("Fau1FGB",), ("Fau1G",), ("FauXCFGB",)], "p string")
    assert rows(census.with_treatment_class(df, "p")) == [("Fau1C", "Intact"), ("Fau1FGB", "Gap"), ("FauXCFGB", "Intact")]


RAW = ("site string, blockID string, turfID string, treatment string, seedID string, Obs string, Comment string, NS string, "
       + ", ".join(f"presence{i} string, date{i} string" for i in range(1, 5)) + ", x double, y string, unID string, Gal_sax string, Viola string")


def record(seed, turf="Fau1C", treatment="C", presence=("1", "NF", None, "1"), comment=None, ns=None, x=1.0, y="2", species=(None, "1", None), site="Fauske"):
    dates = ("1.7.2018", "2/9/2018", "3-7-2019", "8/82019")
    pairs = [v for p in zip(presence, dates) for v in p]
    return (site, "1", turf, treatment, seed, "me", comment, ns, *pairs, x, y, *species)


@pytest.fixture(scope="module")
def prepared(spark):
    data = [record("1"), record("2", comment="out of plot"), record("3", ns="x"), record("4", presence=(None,) * 4),
            record(None, x=300.0), record("6", presence=("0", "0", "0", "3"), species=("1", None, None)),
            record("7", turf="Ovs1FGB", treatment="FGB", presence=("NF", "not found", "0", None), site="Ovstedal"),
            record("8", turf="Ovs2FGB", treatment="FGB", presence=("0", "1?", "1", "0"), site="Ovstedal", y="205/105", species=(None, None, None))]
    return census.prepare_rounds(spark.createDataFrame(data, RAW)).cache()


def test_prepare_rounds(prepared):
    seeds = {r.seedID for r in prepared.collect()}
    assert "1_Fau1C" in seeds and "2_Fau1C" not in seeds and "3_Fau1C" not in seeds and "4_Fau1C" not in seeds
    assert not any(s.endswith("Ovs1FGB") for s in seeds)  # nothing was ever found there
    assert "6_Fau1C" not in seeds and sum(s.startswith("s") for s in seeds) == 3
    split = prepared.where(F.col("seedID").startswith("s"))
    # Each of the three seedlings gets one row per round of the record it came from, seen in round 4.
    assert rows(split.groupBy("round").agg(F.sum("presence").alias("p"), F.count("*").alias("n"))) == [
        (1, 0.0, 3), (2, 0.0, 3), (3, 0.0, 3), (4, 3.0, 3)]
    one = prepared.where("seedID = '1_Fau1C'").orderBy("round").collect()
    assert [r.presence for r in one] == [1.0, 0.0, 0.0, 1.0] and [r.year for r in one] == [2018, 2018, 2019, 2019]
    assert one[3].date == dt.date(2019, 8, 8) and one[0].species == "Gal.sax" and one[0].turfID == "51 TTC" and one[0].blockID == "Fau1"
    made = prepared.where(F.col("seedID").startswith("ran")).first()
    assert made.comment == "coordinate outside plot"
    other = prepared.where("seedID = '8_Ovs2FGB'").first()
    assert other.siteID == "Ovstedalen" and other.y == 205.0 and other.species is None and other.turfID is None


@pytest.fixture(scope="module")
def normals(spark):
    return spark.createDataFrame([("Fauske", 600.0, 10.0), ("Ovstedalen", 2900.0, 10.5)], "siteID string, precipitation double, temperature double")


@pytest.fixture(scope="module")
def plots(spark):
    return spark.createDataFrame([("Fauske", "Fau1", "Fau1C", "C"), ("Ovstedalen", "Ovs1", "Ovs2FGB", "FGB"), ("Fauske", "Fau1", "Fau1XC", "XC"),
                                  ("Fauske", "Fau1", "Fau9C", "C")], "siteID string, blockID string, plotID string, fg_removed string")


def test_plot_round_frame(plots):
    frame = census.plot_round_frame(plots)
    assert frame.count() == 12 and rows(frame.select("year", "round").distinct()) == [(2018, 1), (2018, 2), (2019, 3), (2019, 4)]


def test_clean_rounds(prepared, normals, plots):
    out = census.clean_rounds(community.add_site_context(prepared, normals))
    got = {r.seedID: r for r in out.collect()}
    one = got["1_Fau1C"]
    assert (one.first_occurrence, one.survival_duration, one.season, one.month) == ("spr_18", 2.0, "early", 7)
    late = got["8_Ovs2FGB"]
    assert (late.first_occurrence, late.survival_duration, late.date, late.fg_remaining) == ("aut_18", 2.0, dt.date(2018, 9, 2), "bare")
    assert sum(s.startswith("s") for s in got) == 3 and {r["count"] for r in got.values()} == {1.0}


def coded_row(code, treat, block, seed, species, codes, extra=None):
    return (code, treat, block, seed, None, None, None, species, extra, *codes)


CODED = ("Site string, Treat string, Block string, ID21 string, Species_09_2 string, Species_10_2_2 string, Species_11_1 string, "
         "Species_11_2 string, Rec_11_2 string, C_09_2 string, C_10_1 string, C_10_2 string, C_11_1 string, C_11_2 string, C_12_1 string")


@pytest.fixture(scope="module")
def coded(spark):
    data = [
        coded_row("Ovs ", "RTG", "II", "1", "Ver.alp", ("S", None, "S", "D", None, None)),
        coded_row("Lavi", "RTC", "I", "2", None, (None, None, None, "T", "S", "D")),
        coded_row("Fau", "RTC", "V", None, "Vio pal.cf", (None, "s", "?", None, "1", "H")),
        coded_row("Fau", "RTC", "V", "4", "Poa.pra", ("S",) * 6),
        coded_row("Fau", "TTC", "V", "5", "Vio.pal", ("S",) * 6),
        coded_row("Fau", "RTG", "V", "6", "Vio.pal", (None, "D", None, None, None, None))]
    return census.clean_coded(spark.createDataFrame(data, CODED), "ID21").cache()


def test_clean_coded(coded):
    got = {r.plotID: r for r in coded.collect()}
    first = got["Ovs2RTG"]
    assert (first.siteID, first.treatment, first.first_occurrence, first.survival_duration, first.date) == (
        "Ovstedalen", "Gap", "aut_09", 3.0, dt.date(2009, 9, 1))
    second = got["Lav1RTC"]  # missing before a lost code counts as seen
    assert (second.first_occurrence, second.survival_duration, second.year, second.season) == ("aut_10", 3.0, 2010, "late")
    third = got["Fau5RTC"]
    assert third.ID.startswith("ran-") and third.species == "Vio.pal" and third.survival_duration == 5.0
    assert "Fau5RTG" not in got  # only a dead code in the second census, and the first stays missing


def test_combined_recruits(spark, coded, prepared, normals, plots):
    both = community.add_site_context(coded, normals).withColumnsRenamed({"treatment": "fg_removed", "ID": "seedID"})
    assert "seedID" in both.columns
    rounds = census.clean_rounds(community.add_site_context(prepared, normals))
    rounds = rounds.drop("comment", "functional_group")
    climate = spark.createDataFrame([("Fauske", 2018, 7, 0.5, "x", None)], "siteID string, year int, month int, spei double, season string, date date")
    out = datasets.combined_recruits(both, rounds, climate)
    assert out.count() == both.count() + rounds.count()
    early = out.where("plotID = 'Fau1C' and season = 'early' and year = 2018").collect()
    assert {r.month for r in early} == {7} and {r.spei for r in early} == {0.5} and {r["count"] for r in early} == {float(len(early))}


def test_census_dates_and_counts(spark):
    raw = spark.createDataFrame([("a", "1.7.2018", "8/82019"), ("a", "3.7.2018", "x")], "siteID string, date1 string, date2 string")
    out = census.census_dates(raw, rounds=2)
    assert rows(out) == [("a", "aut_18", dt.date(2019, 8, 8)), ("a", "spr_18", dt.date(2018, 7, 3))]
    counts = spark.createDataFrame([("p", 1.0), ("p", None)], "plot string, n double")
    frame = spark.createDataFrame([("p",), ("q",)], "plot string")
    assert rows(census.complete_counts(counts, frame, ["plot"], "n")) == [("p", 1.0), ("q", 0.0)]


def test_spells(spark):
    months = [dt.date(2019, m, 1) for m in range(3, 9)]
    people = {"dies": [0, 1, 1, 0, 0, 0], "alive": [0, 0, 1, 1, 1, 1], "once": [1, 0, 0, 0, 0, 0], "never": [0] * 6, "returns": [1, 0, 1, 0, 0, 0]}
    data = [("s", n, d, float(c)) for n, h in people.items() for d, c in zip(months, h)]
    df = spark.createDataFrame(data, "siteID string, who string, date date, count double")
    out = {r.who: r for r in survival.spells(df, ["siteID", "who"], "date", "count").collect()}
    assert "never" not in out
    assert (out["dies"].months_til_alive, out["dies"].months_til_dead) == (1.0, 2.0)
    assert (out["alive"].months_til_alive, out["alive"].months_til_dead) == (3.0, 3.0)
    assert (out["once"].months_til_alive, out["once"].months_til_dead) == (0.0, 1.0)
    assert (out["returns"].months_til_alive, out["returns"].months_til_dead) == (2.0, 3.0)
    table = survival.survival_rows(df, ["who"])
    assert rows(table.where("censor = 'right'"), "who") == [("alive",)]
    events = survival.event_rows(df.withColumn("w", F.month("date")), ["siteID", "who"], ["w"])
    assert rows(events.where("who = 'dies'"), "occurrence", "w") == [("first", 4), ("last", 5)]


def test_history_long(spark):
    wide = spark.createDataFrame([("a", 1.0, 0.0)], "id string, spr_18 double, aut_18 double")
    out = survival.history_long(wide, ["id"], {"spr_18": (2018, "early"), "aut_18": (2018, "late")})
    assert rows(out, "season", "count", "date") == [("early", 1.0, dt.date(2018, 7, 1)), ("late", 0.0, dt.date(2018, 8, 1))]


def test_survival_percent(spark):
    df = spark.createDataFrame([("p", "alive"), ("p", "dezd"), ("q", "1")], "plot string, survival string")
    frame = spark.createDataFrame([("p",), ("q",), ("r",)], "plot string")
    assert rows(survival.survival_percent(df, frame, ["plot"]), "plot", "tot", "totS", "survival") == [
        ("p", 2, 1, 50.0), ("q", 1, 1, 100.0), ("r", 0, 0, 0.0)]


COMMUNITY = ("year int, siteID string, blockID string, plotID string, removal string, treatment string, turfID string, species string, "
             "functional_group string, cover double, sumcover double, vegetation_height double, moss_height double, "
             "total_graminoids double, total_forbs double, total_bryophytes double")


@pytest.fixture(scope="module")
def species_rows(spark):
    def row(year, plot, treatment, species, group, cover, moss, grams, forbs, bryo, turf="t"):
        return (year, "Fauske", "x", plot, "r", treatment, turf, species, group, cover, 0.0, 12.0, moss, grams, forbs, bryo)
    data = [
        row(2018, "Fau1C", "C", "Hol.lan", "graminoid", 10.0, None, None, None, 30.0),
        row(2018, "Fau1C", "C", "Vio.pal", "forb", 5.0, None, None, 20.0, 30.0),
        row(2019, "Fau1C", "C", "Vio.pal", "forb", 10.0, 4.0, 50.0, 40.0, 30.0),
        row(2019, "Fau2FGB", "FGB", "Vio.pal", "forb", 10.0, None, None, None, 30.0),
        row(2019, "Fau3C", "C", "Vio.pal", "forb", 8.0, None, 20.0, None, 3.0),
        row(2019, "Fau3C", "C", "Poa.pra", "graminoid", 8.0, None, 20.0, None, 3.0),
        row(2019, "Alr3C", "C", "Poa.pra", "graminoid", 8.0, None, 20.0, None, 3.0, turf=None),
        row(2019, "Fau3C", "C", "Dan.dec", "forb", 8.0, None, 20.0, None, 3.0),
        row(2017, "Fau4XC", "XC", "Vio.pal", "forb", None, None, 20.0, 1.0, 9.0)]
    return spark.createDataFrame(data, COMMUNITY)


def test_clean_community(species_rows, normals):
    out = community.clean_community(species_rows, normals).collect()
    assert not any(r.species == "Dan.dec" or r.plotID == "Alr3C" for r in out)
    cell = {(r.year, r.plotID, r.species): r for r in out}
    assert cell[2018, "Fau1C", "Hol.lan"].total_graminoids == 70 and cell[2018, "Fau1C", "Hol.lan"].total_forbs == 70
    assert cell[2018, "Fau1C", "Vio.pal"].moss_height == 4.0  # the plot's own mean
    assert cell[2019, "Fau3C", "Poa.pra"].moss_height == 0.0  # low moss cover
    treated = cell[2019, "Fau2FGB", "Vio.pal"]
    assert treated.moss_height == 2.0 and treated.imputed_height is True  # site and year mean over plots
    assert cell[2019, "Fau3C", "Poa.pra"].imputed_height is False
    lost = cell[2017, "Fau4XC", "Vio.pal"]
    assert lost.moss_height is None and lost.imputed_height is None and lost.blockID == "Fau4"
    assert lost.sum_cover is None and treated.fg_remaining == "bare" and treated.precipitation == 600.0
    assert treated.temperature_level == "boreal" and treated.precipitation_level == 1


def test_impute_totals_uses_the_slope_through_the_origin(species_rows, normals):
    out = datasets.community(species_rows, normals)
    cell = {(r.year, r.plotID, r.species): r for r in out.collect()}
    slope = (5 * 20 + 10 * 40) / (25 + 100)
    assert cell[2019, "Fau3C", "Vio.pal"].total_forbs == pytest.approx(8 * slope)
    assert cell[2019, "Fau3C", "Poa.pra"].total_forbs is None
    assert cell[2019, "Fau2FGB", "Vio.pal"].total_forbs is None  # nothing remains there
    plots = community.plot_cover(out)
    assert plots.where("fg_removed = 'XC'").count() == 0
    assert "species" in community.cover_rows(out).columns


def test_biomass(spark, normals):
    raw = spark.createDataFrame(
        [(1, 2018, "Ovstedalen", "b", "Ovs1FG", "GF", "G", "graminoids", 1.0), (2, 2018, "Ovstedalen", "b", "Ovs1FG", "GF", "G", "graminoids", 2.0),
         (3, 2017, "Ovstedalen", "b", "Ovs1FG", "GF", "G", "graminoids", 3.0), (4, 2017, "Ovstedalen", "b", "Ovs1FG", "GF", "G", "graminoids", 4.0),
         (5, 2016, "Fauske", "b", "Fau1XC", "XC", "G", "graminoids", 5.0)],
        "i int, year int, siteID string, blockID string, plotID string, treatment string, removed_fg string, functional_group string, biomass double")
    out = community.clean_biomass(raw, normals, ["i"])
    assert rows(out, "i", "plotID") == [(1, "Ovs1GF"), (3, "Ovs1GF"), (4, "Ovs1GF"), (5, "Fau1XC")]
    assert rows(community.control_biomass(out), "i", "standing_biomass") == [(5, 5.0)]


def test_trait_names(spark):
    out = community.describe_traits(spark.createDataFrame([("SLA",), ("fresh_mass_log",), ("zz",)], "trait_trans string"))
    assert rows(out, "trait_trans", "trait_fancy", "figure_names", "class", "trait_order") == [
        ("SLA", "SLA cm2/g", "SLA~(cm^2*g^{-1})", "Leaf economics", 7), ("fresh_mass_log", "Wet mass g", None, "Size", 2),
        ("zz", "zz", None, "Leaf economics", None)]


def test_analysis_table(spark):
    counts = spark.createDataFrame([("a", 2010, 7, 3.0), ("a", 2010, 7, 3.0), ("b", 2010, 7, 500.0)], "siteID string, year int, month int, sumcount double")
    drought = spark.createDataFrame([("a", 2010, 7, 0.5, "x")], "siteID string, year int, month int, spei double, season string")
    weather = spark.createDataFrame([("a", 100.0), ("b", 300.0)], "siteID string, rain double")
    out = datasets.analysis_table(counts, drought, weather, {"srain": "rain"}, {"rain": 100})
    assert rows(out, "siteID", "srain", "year1") == [("a", 0.0, 2)]
