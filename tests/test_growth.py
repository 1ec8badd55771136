"""Steps that must not shuffle or sort every row for a small table, and the cases their short cuts leave to joins."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_field import COMMUNITY, RAW, record

from fieldloom.acceptance import CASES
from fieldloom.functions import gamma
from fieldloom.operators import census, community
from fieldloom.plans import datasets
from fieldloom.sources import records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NORMALS = ([("Fauske", 600.0, 10.0), ("Ovstedalen", 2900.0, 10.5)], "siteID string, precipitation double, temperature double")


def test_recruits_are_joined_without_a_shuffle_of_the_seedlings(spark):
    normals = spark.createDataFrame(*NORMALS)
    out = datasets.rounds_recruits(spark.createDataFrame([record("1"), record(None, x=3.0), record("6", presence=("0", "0", "0", "3"))], RAW), normals)
    assert "SortMergeJoin" not in plan(out) and out.count() == 5
    climate = spark.createDataFrame([("Fauske", 2018, 7, 0.5, "x", None)], "siteID string, year int, month int, spei double, season string, date date")
    both = datasets.combined_recruits(out, out.withColumn("seedID", F.concat(F.lit("b"), "seedID")), climate)
    assert "SortMergeJoin" not in plan(both) and both.count() == 10


def test_ids_of_several_records_keep_every_species_and_date(spark):
    # One id with two comments is two rows; each gets both species, as the records of an id belong together.
    data = [record("1", comment="a"), record("1", comment="b", species=(None, None, "1")), record("2", comment="a")]
    prepared = census.prepare_rounds(spark.createDataFrame(data, RAW))
    out = census.clean_rounds(community.add_site_context(prepared, spark.createDataFrame(*NORMALS)))
    assert rows(out, "seedID", "comment", "species") == [
        ("1_Fau1C", "a", "Gal.sax"), ("1_Fau1C", "a", "Vio.sp"), ("1_Fau1C", "b", "Gal.sax"), ("1_Fau1C", "b", "Vio.sp"), ("2_Fau1C", "a", "Gal.sax")]


def test_a_split_record_takes_the_other_records_of_its_id_along(spark):
    data = [record("1", comment="a"), record("1", comment="b", presence=("0", "0", "0", "2")), record("2")]
    prepared = census.prepare_rounds(spark.createDataFrame(data, RAW))
    assert {r.seedID for r in prepared.collect()} == {"s4.1_1_Fau1C", "s4.2_1_Fau1C", "2_Fau1C"}


def test_quotes_of_ranges_are_counted_without_a_sort_of_the_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\r\na,b\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text('a,b\n2,"z"\n')
    ranges = records.range_parity(records._lines(spark, str(tmp_path)))
    assert "SortAggregate" not in plan(ranges)
    assert rows(ranges, "start", "odd", "open", "opening") == [(0, 0, 0, "a,b"), (0, 0, 0, "a,b")]


def test_a_slope_of_few_groups_shuffles_no_row(spark, tmp_path):
    spark.range(4000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "IF(id % 2 = 0, 'A', 'N') AS l_returnflag", "id * 1.0D AS l_quantity",
                                 "IF(id % 3 = 0, 'F', 'O') AS l_linestatus", "id * 2.0D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "8k")
    try:
        out = CASES["q_slope_impute"].run(spark, str(tmp_path))
        assert "SortMergeJoin" not in plan(out) and out.where("y = 2 * l_orderkey").count() == 4000
    finally:
        spark.conf.set(limit, before)


def test_plots_are_put_together_before_any_join_of_species_rows(spark):
    raw = spark.createDataFrame([(2018, "Fauske", "x", "Fau1C", "r", "C", "t", s, "forb", c, 0.0, 12.0, None, None, 20.0, 30.0) for s, c in (("a", 1.0), ("b", 2.0))]
                                + [(2018, "Fauske", "x", "Alr3C", "r", "C", None, "a", "forb", None, 0.0, 12.0, None, None, 20.0, 30.0)], COMMUNITY)
    normals = spark.createDataFrame(*NORMALS)
    table = datasets.community(raw, normals)
    # One join for the sums, heights and totals of species rows, and one of distinct plots below it.
    assert plan(table).count("SortMergeJoin") <= 2 and rows(table, "species", "sum_cover") == [("a", 3.0), ("b", 3.0)]
    assert rows(datasets.community_plots(raw, normals), "plotID", "sum_cover") == [("Fau1C", 3.0)]


def test_mapped_plots_keep_the_sums_of_the_plots_they_come_from(spark):
    raw = spark.createDataFrame([(2018, "Fauske", "x", p, "r", "C", "t", "a", "forb", c, 0.0, 12.0, 1.0, 5.0, 20.0, 30.0) for p, c in (("Fau1C", 1.0), ("Fau2C", 2.0))], COMMUNITY)
    to_one = spark.createDataFrame([("Fau2C", "Fau1C")], "from_key string, to_key string")
    table = datasets.community(raw, spark.createDataFrame(*NORMALS), to_one)
    assert rows(table, "plotID", "cover", "sum_cover") == [("Fau1C", 1.0, 1.0), ("Fau1C", 2.0, 2.0)]


def test_poisson_tails_take_the_same_steps_for_any_count(spark):
    # Around the counts and the mean where masses are no longer summed, far into both tails, and for counts of any size.
    cases = [(y, mu) for y in (0, 1, 7, 31, 32, 33, 400, 5000) for mu in (0.0, 1e-9, 0.4, 4.0, 31.9, 32.1, 699.0, 701.0, 5050.0, 9000.0)]
    df = spark.createDataFrame(cases, "y int, mu double").select("y", "mu", gamma.poisson_cdf("y", "mu").alias("cdf"))
    assert "sequence(" not in plan(df)
    for r in df.collect():
        mass = [math.exp(k * math.log(r.mu) - r.mu - math.lgamma(k + 1)) if r.mu else float(k == 0) for k in range(r.y + 1)]
        assert r.cdf == pytest.approx(min(1.0, math.fsum(mass)), rel=1e-9, abs=1e-13), (r.y, r.mu)
    endless = spark.createDataFrame([(1e12, 1e12 + 5e6), (1e12, 2e12), (2e12, 1e12), (math.inf, 2.0), (40.0, None), (None, 2.0)], "y double, mu double")
    found = [r[0] for r in endless.select(gamma.poisson_cdf("y", "mu")).collect()]
    assert 0 <= found[0] < 1e-6 and found[1:] == [0.0, 1.0, 1.0, None, None]
