"""The missing-value contract, text, dates, column operators."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldloom.functions import dates, nulls, text
from fieldloom.functions.lookups import level_order, lookup, recode, site_table, control_turf_table
from fieldloom.operators import columns as cols


@pytest.fixture(scope="module")
def contract(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0, True), (2, None, None, None), (3, "b", 3.0, False), (4, "1?", 2.0, True)],
        "id int, s string, x double, b boolean")


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_membership_and_patterns_are_never_missing(contract):
    assert values(contract, nulls.is_in("s", ["a"]).alias("v")) == [True, False, False, False]
    assert values(contract, nulls.not_in("s", ["a"]).alias("v")) == [False, True, True, True]
    assert values(contract, nulls.matches("s", "a|b").alias("v")) == [True, False, True, False]


def test_if_else_keeps_missing_conditions(contract):
    assert values(contract, nulls.if_else(F.col("b"), F.lit("y"), F.lit("n")).alias("v")) == ["y", None, "n", "y"]


def test_paste_writes_missing_as_text(contract):
    assert values(contract, nulls.paste(F.lit("x"), F.col("s")).alias("v")) == ["xa", "xNA", "xb", "x1?"]


def test_to_number_of_bad_text_is_missing(contract):
    assert values(contract, nulls.to_number("s").alias("v")) == [None] * 4


def test_strict_and_skipping_aggregates(contract):
    got = contract.agg(nulls.sum_strict("x").alias("a"), nulls.sum_skip("x").alias("b"), nulls.mean_strict("x").alias("c"),
                       nulls.mean_skip("x").alias("d"), nulls.weighted_mean("x", "id").alias("e")).first()
    assert tuple(got) == (None, 6.0, None, 2.0, None)
    empty = contract.where("x is null").agg(nulls.sum_skip("x").alias("b"), nulls.mean_skip("x").alias("d")).first()
    assert tuple(empty) == (0, None)


def test_row_sum(contract):
    both = contract.withColumn("y", F.lit(1.0))
    assert values(both, nulls.row_sum(["x", "y"]).alias("v")) == [2.0, None, 4.0, 3.0]
    assert values(both, nulls.row_sum(["x", "y"], skip_missing=True).alias("v")) == [2.0, 1.0, 4.0, 3.0]


def test_text_functions(spark):
    df = spark.createDataFrame([(1, "Gal_sax_x"), (2, None), (3, "\t a \n")], "id int, s string")
    assert values(df, text.replace_first("s", "_", ".").alias("v")) == ["Gal.sax_x", None, "\t a \n"]
    assert values(df, text.replace_all("s", "_", ".").alias("v"))[0] == "Gal.sax.x"
    assert values(df, text.strip("s").alias("v"))[2] == "a"
    assert values(df, text.substr("s", 2, 3).alias("v"))[0] == "al"
    assert values(df, text.piece("s", "_", 2).alias("v"))[0] == "sax"
    assert values(df, text.before_first("s", "_ -").alias("v"))[0] == "Gal"


def test_dates(spark):
    df = spark.createDataFrame([(1, "8.8.2019"), (2, "08/08/2019"), (3, "8/82019"), (4, None)], "id int, s string")
    day = dt.date(2019, 8, 8)
    assert values(df, dates.parse_day_month_year("s").alias("v")) == [day, day, None, None]
    one = spark.createDataFrame([(1, "aut_09")], "id int, s string")
    assert values(one, dates.year_of_code("s").alias("v")) == [2009]
    assert values(one, dates.day_number_to_date(F.lit(31), "2018-01-01").alias("v")) == [dt.date(2018, 2, 1)]
    assert values(one, dates.parse_month_year(F.lit("7-2018")).alias("v")) == [dt.date(2018, 7, 1)]
    assert values(one, dates.months_from(F.to_date(F.lit("2018-07-01")), F.to_date(F.lit("2019-08-01"))).alias("v")) == [13.0]
    months = spark.range(1, 13).select(F.col("id"), dates.season_of_month("id").alias("v"))
    assert values(months, "v") == ["1", "1", "2", "2", "2", "early", "early", "late", "late", "late", "late", "1"]


def test_lookup_and_recode(contract):
    assert values(contract, lookup("s", {"a": 1}).alias("v")) == [1, None, None, None]
    assert values(contract, recode("s", {"a": "z"}).alias("v")) == ["z", None, "b", "1?"]
    assert values(contract, level_order("s", ["b", "a"]).alias("v")) == [2, None, 1, None]


def test_fixed_tables(spark):
    assert site_table(spark).select("new").distinct().count() == 12
    assert control_turf_table(spark).select("plotID").distinct().count() == 31


def test_ranges_and_sequence(contract):
    assert cols.cols_between(contract, "s", "b") == ["s", "x", "b"]
    assert cols.cols_matching(contract, "^[sx]$") == ["s", "x"]
    out = cols.derive(contract, x=F.col("x") + 1, y=F.col("x") * 10)
    assert values(out, "y") == [20.0, None, 40.0, 30.0]


def test_patch_cells_matches_missing_keys(spark, contract):
    fixes = spark.createDataFrame([(None, 9.0), ("b", None)], "s string, x double")
    assert values(cols.patch_cells(contract, fixes, ["s"], ["x"]), "x") == [1.0, 9.0, 3.0, 2.0]


def test_dummies_and_levels(contract):
    out, names = cols.dummies(contract, "s", ["a", "b"], "a")
    assert names == ["sb"] and values(out, "sb") == [0.0, None, 1.0, 0.0]
    ranked = cols.order_levels_by(contract.where("s is not null"), "s", "x")
    assert rows(ranked, "s", "level_order") == [("1?", 2), ("a", 1), ("b", 3)]


def test_zscore_has_mean_zero_and_sd_one(contract):
    out = cols.zscore(contract, {"z": "x"}).agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).first()
    assert out.m == pytest.approx(0) and out.s == pytest.approx(1)
